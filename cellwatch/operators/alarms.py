"""Debounced alarms as finite-state machines.

An alarm compares its input only with fixed thresholds, so an input matters
only through the interval it falls into.  Each alarm is therefore one table
``(interval, state) -> (next state, level)``; the row loop is a table lookup,
and what a stretch of rows does to an unknown state is again a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import FourLevel, TwoLevel

START = ("start", 0, 0)


def resting(level: int) -> tuple:
    return ("resting", level, 0)


def pending(level: int, waited: int = 0) -> tuple:
    return ("pending", level, waited)


def four_level_step(t: FourLevel, state: tuple, x: float) -> tuple[tuple, int]:
    """Next state and reported level of a four-level alarm for one input."""
    kind, level, waited = state
    if kind == "start":
        return resting(0), 0
    if kind == "pending":
        if x < t.settle[level - 1]:
            return resting(level - 1), level - 1
        if x >= t.rise[level - 1] and waited >= t.debounce_rows:
            return resting(level), level
        return pending(level, min(waited + 1, t.debounce_rows)), 0
    reached = sum(x >= threshold for threshold in t.rise)
    if reached > level:
        return pending(reached), level
    if level and x < t.clear[level - 1]:
        return resting(level - 1), level
    return state, level


def two_level_step(t: TwoLevel, state: tuple, x: float) -> tuple[tuple, int]:
    """Next state and reported level of a two-level alarm for one input."""
    kind, level, waited = state
    if kind == "start":
        return resting(0), 0
    if kind == "pending":
        if x < t.settle[level - 1]:
            return resting(level - 1), level - 1
        if waited >= t.debounce_rows:
            return resting(level), level
        return pending(level, waited + 1), 0
    if level and x < t.clear[level - 1]:
        return resting(level - 1), level - 1
    reached = sum(x >= threshold for threshold in t.rise)
    if reached > level:
        return pending(reached), level
    return state, level if level != 1 or t.sticky else 0


def state_name(state: tuple) -> str:
    kind, level, waited = state
    if kind == "start":
        return "start"
    if kind == "resting":
        return f"warn{level}" if level else "normal"
    return f"pending{level}" + (f"+{waited}" if waited else "")


@dataclass(frozen=True)
class AlarmTable:
    """``next_state`` and ``level`` are flat, indexed ``interval * len(names) + state``."""

    names: list[str]
    cuts: np.ndarray
    next_state: np.ndarray
    level: np.ndarray

    def intervals(self, x: np.ndarray) -> np.ndarray:
        """Row offsets into the flat tables."""
        found = self.cuts.searchsorted(x, side="right")
        blank = np.isnan(x)
        if blank.any():
            found = np.where(blank, len(self.cuts) + 1, found)
        return found * len(self.names)


def alarm_table(thresholds: FourLevel | TwoLevel) -> AlarmTable:
    """Tabulate an alarm by asking its step once per interval and state."""
    step = four_level_step if isinstance(thresholds, FourLevel) else two_level_step
    if list(thresholds.rise) != sorted(thresholds.rise):
        raise ValueError("alarm thresholds must rise with the level")
    levels = range(1, len(thresholds.rise) + 1)
    states = [START, *[resting(k) for k in (0, *levels)]]
    states += [pending(k, w) for k in levels for w in range(thresholds.debounce_rows + 1)]
    cuts = sorted({*thresholds.rise, *thresholds.settle, *thresholds.clear})
    # One input per interval: below all cuts, each cut itself, and NaN.
    probes = [float("-inf"), *cuts, float("nan")]
    pairs = [step(thresholds, s, x) for x in probes for s in states]
    position = {s: i for i, s in enumerate(states)}
    return AlarmTable(
        names=[state_name(s) for s in states],
        cuts=np.array(cuts),
        next_state=np.array([position[s] for s, _ in pairs]),
        level=np.array([lvl for _, lvl in pairs], dtype=np.int32),
    )
