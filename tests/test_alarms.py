"""Every alarm state on every side of its thresholds."""

from dataclasses import replace

import numpy as np
import pytest

from cellwatch.config import Config, FourLevel, TwoLevel
from cellwatch.operators.alarms import alarm_table
from cellwatch.operators.scans import Alarm

FOUR = FourLevel(rise=(10, 20, 30, 40), settle=(8, 18, 28, 38), clear=(6, 16, 26, 36))
TWO = TwoLevel(rise=(10, 20), settle=(8, 18), clear=(6, 16))
NAN = float("nan")

# state, input, next state, reported level
FOUR_CASES = [
    ("start", 99, "normal", 0),
    ("normal", 9.9, "normal", 0), ("normal", 10, "pending1", 0), ("normal", 19.9, "pending1", 0),
    ("normal", 20, "pending2", 0), ("normal", 30, "pending3", 0), ("normal", 40, "pending4", 0),
    ("pending1", 7.9, "normal", 0), ("pending1", 8, "pending1", 0), ("pending1", 9.9, "pending1", 0),
    ("pending1", 10, "warn1", 1), ("pending1", 99, "warn1", 1),
    ("pending2", 0, "warn1", 1), ("pending2", 17.9, "warn1", 1), ("pending2", 18, "pending2", 0),
    ("pending2", 20, "warn2", 2),
    ("pending3", 0, "warn2", 2), ("pending3", 28, "pending3", 0), ("pending3", 30, "warn3", 3),
    ("pending4", 0, "warn3", 3), ("pending4", 38, "pending4", 0), ("pending4", 40, "warn4", 4),
    ("warn1", 5.9, "normal", 1), ("warn1", 6, "warn1", 1), ("warn1", 10, "warn1", 1),
    ("warn1", 20, "pending2", 1), ("warn1", 30, "pending3", 1), ("warn1", 40, "pending4", 1),
    ("warn2", 15.9, "warn1", 2), ("warn2", 16, "warn2", 2), ("warn2", 30, "pending3", 2), ("warn2", 40, "pending4", 2),
    ("warn3", 25.9, "warn2", 3), ("warn3", 26, "warn3", 3), ("warn3", 40, "pending4", 3),
    ("warn4", 35.9, "warn3", 4), ("warn4", 36, "warn4", 4), ("warn4", 99, "warn4", 4),
    *[(s, NAN, s, level) for s, level in (("normal", 0), ("warn1", 1), ("warn2", 2), ("warn3", 3), ("warn4", 4),
                                          ("pending1", 0), ("pending2", 0), ("pending3", 0), ("pending4", 0))],
]
TWO_CASES = [
    ("start", 99, "normal", 0),
    ("normal", 9.9, "normal", 0), ("normal", 10, "pending1", 0), ("normal", 20, "pending2", 0),
    ("pending1", 7.9, "normal", 0), ("pending1", 8, "warn1", 1), ("pending1", 99, "warn1", 1),
    ("pending2", 17.9, "warn1", 1), ("pending2", 18, "warn2", 2),
    ("warn1", 5.9, "normal", 0), ("warn1", 6, "warn1", 0), ("warn1", 19.9, "warn1", 0), ("warn1", 20, "pending2", 1),
    ("warn2", 15.9, "warn1", 1), ("warn2", 16, "warn2", 2), ("warn2", 99, "warn2", 2),
    ("normal", NAN, "normal", 0), ("pending1", NAN, "warn1", 1), ("pending2", NAN, "warn2", 2),
    ("warn1", NAN, "warn1", 0), ("warn2", NAN, "warn2", 2),
]


@pytest.mark.parametrize("thresholds,cases", [(FOUR, FOUR_CASES), (TWO, TWO_CASES)])
def test_transitions(thresholds, cases):
    alarm = Alarm("a", "x", thresholds)
    for state, x, want, level in cases:
        out, after = alarm.run({"x": np.array([float(x)])}, state)
        assert (after, out["a"][0]) == (want, level), (state, x)


@pytest.mark.parametrize("name", ["wp", "wsoc", "wtt", "wv", "wt"])
def test_inputs_exactly_on_the_default_thresholds(name):
    thresholds = getattr(Config(), name)
    table = alarm_table(thresholds)
    offsets = table.intervals(table.cuts) // len(table.names)
    assert offsets.tolist() == list(range(1, len(table.cuts) + 1))
    below = np.nextafter(table.cuts, -np.inf)
    assert (table.intervals(below) // len(table.names)).tolist() == list(range(len(table.cuts)))


def levels(thresholds, xs):
    return Alarm("a", "x", thresholds).run({"x": np.array(xs, dtype=float)}, "start")[0]["a"].tolist()


def test_one_row_confirms_by_default_and_debounce_rows_wait_longer():
    xs = [0, 15, 15, 15, 15, 15, 15]
    assert levels(FOUR, xs) == [0, 0, 1, 1, 1, 1, 1]
    assert levels(replace(FOUR, debounce_rows=3), xs) == [0, 0, 0, 0, 0, 1, 1]
    assert levels(TWO, xs) == [0, 0, 1, 0, 0, 0, 0]
    assert levels(replace(TWO, debounce_rows=3, sticky=True), xs) == [0, 0, 0, 0, 0, 1, 1]


def test_sticky_keeps_reporting_level_one():
    xs = [0, 15, 15, 15, 15, 5, 5]
    assert levels(TWO, xs) == [0, 0, 1, 0, 0, 0, 0]
    assert levels(replace(TWO, sticky=True), xs) == [0, 0, 1, 1, 1, 0, 0]


def test_nominal_debounce():
    config = Config().debounced()
    assert (config.wp.debounce_rows, config.wtt.debounce_rows, config.wv.debounce_rows) == (5, 3, 5)
