"""Ordered recurrences over one order's rows.

A scan turns columns into columns while carrying a small state.  Besides
running from a known state it can *summarize* a stretch of rows whose entry
state is not known yet: ``absorb`` folds rows into a summary of fixed size and
``resolve`` applies a summary to a state.  That is what lets Spark cut a very
long order into segments, summarize them all at once and then run them all at
once, with the same results as one pass.

States and summaries are JSON values, so they travel in string columns.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np

from ..config import FourLevel, SPIKE_ROWS, TwoLevel
from .alarms import alarm_table
from .lanes import Lanes


class Scan:
    """``name`` keys the state; ``outputs`` are the columns ``run`` returns."""

    #: False for recurrences without a fixed-size summary.
    summarizes = True
    #: Whether ``resolve`` gives the very state that ``run`` would end in; else it is a guess to be tried.
    exact = True

    def __init__(self, name: str, *inputs: str):
        self.name = name
        self.inputs = inputs

    @property
    def outputs(self) -> tuple[str, ...]:
        return (self.name,)

    def run_lanes(self, cols, lanes: Lanes, states: list) -> tuple[dict, list]:
        """``run`` of many orders: columns of all their rows, and the state each order ends in."""
        parts, after = [], []
        for lo, hi, state in zip(lanes.starts.tolist(), lanes.ends.tolist(), states):
            out, state = self.run({n: cols[n][lo:hi] for n in self.inputs}, state)
            parts.append(out)
            after.append(state)
        return {n: np.concatenate([p[n] for p in parts]) for n in self.outputs}, after


class Stepped(Scan):
    """A recurrence that takes a row of all orders at a time.

    ``packed`` turns states into arrays, one entry an order, and ``unpacked`` turns them back;
    ``step`` takes these arrays and a row of each order and returns the arrays and outputs of
    the types ``step_types``.  Rows and states get the same operations as in ``run``.
    """

    step_types: tuple = (np.float64,)

    @property
    def step_outputs(self) -> tuple[str, ...]:
        return self.outputs

    def step_inputs(self, cols) -> tuple[np.ndarray, ...]:
        return (cols[self.inputs[0]],)

    def outputs_of_steps(self, columns: list[np.ndarray], lanes: Lanes, states: list) -> dict:
        return dict(zip(self.outputs, columns))

    def run_lanes(self, cols, lanes, states):
        ranked = lanes.ranked
        now = self.packed([states[i] for i in ranked.tolist()])
        parts: list[list[np.ndarray]] = [[] for _ in self.step_types]
        for xs in lanes.steps(*self.step_inputs(cols)):
            n = len(xs[0])
            stepped, out = self.step(tuple(a[:n] for a in now), *xs)
            for whole, some in zip(now, stepped):
                whole[:n] = some
            for part, values in zip(parts, out):
                part.append(values)
        columns = [lanes.collected(part, kind) for part, kind in zip(parts, self.step_types)]
        ended = self.unpacked(now)
        for rank, rows in lanes.rest():
            out, ended[rank] = self.run({n: cols[n][rows] for n in self.inputs}, ended[rank])
            for whole, name in zip(columns, self.step_outputs):
                whole[rows] = out[name]
        after = [None] * len(lanes)
        for i, state in zip(ranked.tolist(), ended):
            after[i] = state
        return self.outputs_of_steps(columns, lanes, states), after


class Decay(Stepped):
    """Exponential smoothing ``y = keep * y_before + (1 - keep) * x`` from 0.

    Its summary rounds otherwise than the rows do.
    """

    exact = False

    def __init__(self, name: str, x: str, keep: float):
        super().__init__(name, x)
        self.keep = keep

    def initial(self):
        return 0.0

    def run(self, cols, state):
        keep, take = self.keep, 1 - self.keep
        ys = list(accumulate(cols[self.inputs[0]].tolist(), lambda y, x: keep * y + take * x, initial=state))
        return {self.name: np.array(ys[1:])}, ys[-1]

    def packed(self, states):
        return (np.array(states, np.float64),)

    def unpacked(self, now):
        return now[0].tolist()

    def step(self, now, x):
        y = self.keep * now[0] + (1 - self.keep) * x
        return (y,), (y,)

    def unknown(self):
        return [1.0, 0.0]

    def absorb(self, summary, cols):
        factor, offset = summary
        _, offset = self.run(cols, offset)
        return [factor * self.keep ** len(cols[self.inputs[0]]), offset]

    def resolve(self, summary, state):
        return summary[0] * state + summary[1]


class Alarm(Stepped):
    """Reported level of a debounced alarm; the state is its state's name."""

    def __init__(self, name: str, x: str, thresholds: FourLevel | TwoLevel, with_state: bool = False):
        super().__init__(name, x)
        self.table = alarm_table(thresholds)
        self._steps = self.table.next_state.tolist()
        self.with_state = with_state

    @property
    def outputs(self):
        return (self.name, f"{self.name}_state") if self.with_state else (self.name,)

    def initial(self):
        return "start"

    def _walk(self, offsets: np.ndarray, at: int) -> np.ndarray:
        """The state before each row, and after the last."""
        if (self.table.next_state[offsets + at] == at).all():
            return np.full(len(offsets) + 1, at)
        step = self._steps
        return np.array(list(accumulate(offsets.tolist(), lambda now, offset: step[offset + now], initial=at)))

    def run(self, cols, state):
        names = self.table.names
        offsets = self.table.intervals(cols[self.inputs[0]])
        states = self._walk(offsets, names.index(state))
        out = {self.name: self.table.level[offsets + states[:-1]]}
        if self.with_state:
            out[f"{self.name}_state"] = np.array(names, dtype=object)[states[1:]]
        return out, names[states[-1]]

    @property
    def step_types(self):
        return (self.table.level.dtype, object) if self.with_state else (self.table.level.dtype,)

    def step_inputs(self, cols):
        return (self.table.intervals(cols[self.inputs[0]]),)

    def packed(self, states):
        place = {name: i for i, name in enumerate(self.table.names)}
        return (np.array([place[x] for x in states], np.int64),)

    def unpacked(self, now):
        return [self.table.names[i] for i in now[0].tolist()]

    def step(self, now, offset):
        at = offset + now[0]
        after, level = self.table.next_state[at], self.table.level[at]
        return (after,), (level, np.array(self.table.names, dtype=object)[after]) if self.with_state else (level,)

    def unknown(self):
        return list(range(len(self.table.names)))

    def absorb(self, summary, cols):
        offsets = self.table.intervals(cols[self.inputs[0]])
        at = {first: first for first in summary}
        for i, offset in enumerate(offsets.tolist()):
            if len(set(at.values())) == 1:
                # All starts have met: from here on a single walk is enough.
                at = dict.fromkeys(at, int(self._walk(offsets[i:], next(iter(at.values())))[-1]))
                break
            at = {first: self._steps[offset + now] for first, now in at.items()}
        return [at[first] for first in summary]

    def resolve(self, summary, state):
        return self.table.names[summary[self.table.names.index(state)]]


def hold_step(count: int, held: float, x: float) -> tuple[int, float]:
    """One row of the spike hold; ``count`` rows disagreed, counting the agreeing one."""
    if count == 0:
        held = x
    count = 1 if held == x else min(count + 1, SPIKE_ROWS + 1)
    return count, x if count > SPIKE_ROWS else held


class SpikeHold(Stepped):
    """Hold a value until the input has disagreed for more than ten rows.

    Whatever a segment was entered with, within ten rows it either meets the
    held value or gives it up, and both leave a state that the segment's own
    rows decide.  So the summary keeps the first ten inputs and, for each, how
    the segment ends when the value was met or given up there.
    """

    @property
    def outputs(self):
        return (self.name, f"{self.name}_before")

    def initial(self):
        return [0, 0.0]

    def run(self, cols, state):
        xs = cols[self.inputs[0]]
        count, held = state
        if count == 1 and (xs == held).all():
            return {self.name: xs, f"{self.name}_before": xs}, state
        after = []
        for x in xs.tolist():
            if x == held and count:
                count = 1
            else:
                count, held = hold_step(count, held, x)
            after.append(held)
        after = np.array(after)
        before = np.concatenate(([state[1]], after[:-1]))
        return {self.name: after, f"{self.name}_before": before}, [count, held]

    @property
    def step_outputs(self):
        return (self.name,)

    def packed(self, states):
        return np.array([s[0] for s in states], np.int64), np.array([s[1] for s in states], np.float64)

    def unpacked(self, now):
        return [list(s) for s in zip(now[0].tolist(), now[1].tolist())]

    def step(self, now, x):
        count, held = now
        held = np.where(count == 0, x, held)
        count = np.where(held == x, 1, np.minimum(count + 1, SPIKE_ROWS + 1))
        held = np.where(count > SPIKE_ROWS, x, held)
        return (count, held), (held,)

    def outputs_of_steps(self, columns, lanes, states):
        before = lanes.before(columns[0], np.array([s[1] for s in states], np.float64))
        return {self.name: columns[0], f"{self.name}_before": before}

    def unknown(self):
        return {"seen": [], "met": [], "gave_up": []}

    def absorb(self, summary, cols):
        xs = cols[self.inputs[0]].tolist()
        seen, met, gave_up = (list(summary[k]) for k in ("seen", "met", "gave_up"))
        fresh = max(0, min(SPIKE_ROWS - len(seen), len(xs)))
        for x in xs[:fresh]:
            met = [hold_step(*s, x) for s in met] + [(1, x)]
            gave_up = [hold_step(*s, x) for s in gave_up] + [(SPIKE_ROWS + 1, x)]
            seen.append(x)
        ends = [tuple(s) for s in (*met, *gave_up)]
        now = {s: s for s in ends}
        for x in xs[fresh:]:
            stepped = {s: hold_step(*s, x) for s in set(now.values())}
            now = {first: stepped[s] for first, s in now.items()}
        ends = [list(now[s]) for s in ends]
        return {"seen": seen, "met": ends[: len(seen)], "gave_up": ends[len(seen):]}

    def resolve(self, summary, state):
        count, held = state
        seen = summary["seen"]
        if count == 0:
            return summary["met"][0]
        patience = max(1, SPIKE_ROWS + 1 - count)
        for i, x in enumerate(seen[:patience]):
            if x == held:
                return summary["met"][i]
        if len(seen) < patience:
            return [count + len(seen), held]
        return summary["gave_up"][patience - 1]


class Before(Scan):
    """The previous row's value, ``default`` on an order's first row."""

    def __init__(self, name: str, x: str, default: float = 0.0):
        super().__init__(name, x)
        self.default = default

    def initial(self):
        return self.default

    def run(self, cols, state):
        xs = cols[self.inputs[0]]
        return {self.name: np.concatenate(([state], xs[:-1]))}, float(xs[-1])

    def run_lanes(self, cols, lanes, states):
        xs = cols[self.inputs[0]]
        return {self.name: lanes.before(xs, np.array(states, np.float64))}, xs[lanes.ends - 1].astype(float).tolist()

    def unknown(self):
        return self.default

    def absorb(self, summary, cols):
        return float(cols[self.inputs[0]][-1])

    def resolve(self, summary, state):
        return summary


class RunLength(Scan):
    """Rows since the last change, and the length of the run before it.

    The input is a boolean column that marks changes.  The state is
    ``[counter, previous run's counter]``.
    """

    @property
    def outputs(self):
        return (f"{self.name}_counter", f"{self.name}_previous")

    def initial(self):
        return [1, 1]

    def run(self, cols, state):
        changed = cols[self.inputs[0]]
        counter, previous = state
        at = np.arange(len(changed))
        since = np.maximum.accumulate(np.where(changed, at, -1))
        changes = np.flatnonzero(changed)
        lengths = np.diff(np.concatenate(([-counter], changes)))
        counters = np.where(since >= 0, at - since + 1, counter + at + 1)
        previous_at = np.concatenate(([previous], lengths))[np.cumsum(changed)]
        out = {f"{self.name}_counter": counters, f"{self.name}_previous": previous_at}
        return out, [int(counters[-1]), int(previous_at[-1])]

    def run_lanes(self, cols, lanes, states):
        changed = cols[self.inputs[0]]
        counter, previous = (np.array([s[i] for s in states], np.int64) for i in (0, 1))
        at, of, since = np.arange(lanes.rows), lanes.of_row, lanes.since(changed)
        changes = np.flatnonzero(changed)
        # The run before a change began at the order's change before, or came in with it.
        begun = np.concatenate(([-1], changes[:-1]))
        entered = (lanes.starts - counter)[of[changes]]
        lengths = np.zeros(lanes.rows, np.int64)
        lengths[changes] = changes - np.where(begun >= lanes.starts[of[changes]], begun, entered)
        counters = np.where(since >= 0, at - since + 1, (counter - lanes.starts)[of] + at + 1)
        previous_at = np.where(since >= 0, lengths[np.maximum(since, 0)], previous[of])
        last = lanes.ends - 1
        after = [list(s) for s in zip(counters[last].tolist(), previous_at[last].tolist())]
        return {f"{self.name}_counter": counters, f"{self.name}_previous": previous_at}, after

    def unknown(self):
        return {"lead": 0, "changes": 0, "counter": 0, "previous": 0}

    def absorb(self, summary, cols):
        changed = cols[self.inputs[0]]
        changes = np.flatnonzero(changed)
        lead, seen = summary["lead"], summary["changes"]
        if not seen:
            lead += int(changes[0]) if len(changes) else len(changed)
            if not len(changes):
                return {**summary, "lead": lead}
        _, (counter, previous) = self.run(cols, [summary["counter"], summary["previous"]])
        return {"lead": lead, "changes": seen + len(changes), "counter": counter, "previous": previous}

    def resolve(self, summary, state):
        counter, previous = state
        if not summary["changes"]:
            return [counter + summary["lead"], previous]
        if summary["changes"] == 1:
            return [summary["counter"], counter + summary["lead"]]
        return [summary["counter"], summary["previous"]]


class Total(Scan):
    """Running total of an integer column."""

    def initial(self):
        return 0

    def run(self, cols, state):
        sums = np.cumsum(cols[self.inputs[0]], dtype=np.int64) + state
        return {self.name: sums}, int(sums[-1])

    def run_lanes(self, cols, lanes, states):
        sums = lanes.running_sums(cols[self.inputs[0]], np.array(states, np.int64))
        return {self.name: sums}, sums[lanes.ends - 1].tolist()

    def unknown(self):
        return 0

    def absorb(self, summary, cols):
        return summary + int(cols[self.inputs[0]].sum())

    def resolve(self, summary, state):
        return summary + state


class LatestMarked(Scan):
    """Value of the latest marked row, before any mark that of the first row."""

    def initial(self):
        return [None, None]

    def run(self, cols, state):
        values, marks = (cols[c] for c in self.inputs)
        first, latest = state
        first = values[0] if first is None else first
        source = np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))
        picked = np.concatenate((np.array([first if latest is None else latest], dtype=object), values))
        latest = values[source[-1]] if source[-1] >= 0 else latest
        return {self.name: picked[source + 1]}, [first, latest]

    def run_lanes(self, cols, lanes, states):
        values, marks = (cols[c] for c in self.inputs)
        firsts = [v if s[0] is None else s[0] for s, v in zip(states, values[lanes.starts])]
        entered = np.empty(len(lanes), dtype=object)
        entered[:] = [f if s[1] is None else s[1] for s, f in zip(states, firsts)]
        source = lanes.since(marks)
        picked = np.where(source >= 0, values[np.maximum(source, 0)], entered[lanes.of_row])
        last = source[lanes.ends - 1].tolist()
        after = [[f, values[i] if i >= 0 else s[1]] for f, i, s in zip(firsts, last, states)]
        return {self.name: picked}, after

    def unknown(self):
        return [None, None]

    def absorb(self, summary, cols):
        return self.run(cols, summary)[1]

    def resolve(self, summary, state):
        first = summary[0] if state[0] is None else state[0]
        return [first, state[1] if summary[1] is None else summary[1]]
