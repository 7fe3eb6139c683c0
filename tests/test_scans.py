"""Scans against plain row loops, and cut scans against whole ones."""

import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cellwatch.config import FourLevel, TwoLevel
from cellwatch.operators.lanes import LEAST_LANES, Lanes
from cellwatch.operators.scans import Alarm, Before, Decay, LatestMarked, RunLength, SpikeHold, Total

FOUR = FourLevel(rise=(2, 4, 6, 8), settle=(1.5, 3.5, 5.5, 7.5), clear=(1, 3, 5, 7), debounce_rows=2)
TWO = TwoLevel(rise=(3, 6), settle=(2, 5), clear=(1, 4))

SCANS = [
    Decay("s", "x", 0.9),
    Alarm("s", "x", FOUR),
    Alarm("s", "x", TWO),
    SpikeHold("s", "x"),
    Before("s", "x"),
    RunLength("s", "b"),
    Total("s", "i"),
    LatestMarked("s", "t", "b"),
]
# Few distinct values, so that values recur, runs form and holds are met.
NUMBERS = st.lists(st.sampled_from([0.0, 1.0, 2.5, 4.0, 6.5, 9.0]), min_size=1, max_size=80)
CUTS = st.lists(st.integers(1, 80), max_size=6)


def columns(values):
    x = np.array(values)
    return {"x": x, "b": x > 3, "i": (x > 3).astype(int), "t": np.array([f"d{v}" for v in values], dtype=object)}


def pieces(cols, cuts):
    n = len(cols["x"])
    bounds = sorted({0, n, *[c for c in cuts if c < n]})
    return [{k: v[lo:hi] for k, v in cols.items()} for lo, hi in zip(bounds, bounds[1:])]


def same(a, b):
    if a.dtype == object:
        return a.tolist() == b.tolist()
    return np.allclose(a, b, rtol=0, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("scan", SCANS, ids=lambda s: type(s).__name__)
@settings(max_examples=150, deadline=None)
@given(values=NUMBERS, cuts=CUTS, more=CUTS)
def test_summaries_replace_a_pass(scan, values, cuts, more):
    cols = columns(values)
    whole, end = scan.run(cols, scan.initial())
    state, got = scan.initial(), []
    for piece in pieces(cols, cuts):
        out, after = scan.run(piece, state)
        got.append(out)
        summary = scan.unknown()
        for batch in pieces(piece, more):
            summary = json.loads(json.dumps(scan.absorb(summary, batch)))
        resolved = scan.resolve(summary, json.loads(json.dumps(state)))
        assert json.loads(json.dumps(resolved)) == pytest.approx(json.loads(json.dumps(after)), abs=1e-12)
        state = json.loads(json.dumps(after))
    for name in scan.outputs:
        assert same(np.concatenate([g[name] for g in got]), whole[name])
    assert json.loads(json.dumps(end)) == pytest.approx(state, abs=1e-12)


def hold_by_rows(xs):
    """Held values from the distance to the last row that agreed."""
    out, agreed = [xs[0]], 0
    for i, x in enumerate(xs[1:], start=1):
        if x == out[-1]:
            agreed = i
        out.append(x if i - agreed >= 10 else out[-1])
    return out


@settings(max_examples=200, deadline=None)
@given(NUMBERS)
def test_spike_hold(values):
    assert SpikeHold("s", "x").run(columns(values), [0, 0.0])[0]["s"].tolist() == hold_by_rows(values)


def test_spikes_of_nine_and_ten_rows():
    for rows, passed in ((9, 0), (10, 1), (11, 2)):
        xs = [20.0, *[float(30 + i) for i in range(rows)], 20.0]
        held = SpikeHold("s", "x").run({"x": np.array(xs)}, [0, 0.0])[0]["s"].tolist()
        assert sum(h != 20.0 for h in held) == passed
        assert held == hold_by_rows(xs)


def runs_by_rows(changes):
    counter, previous, out = 1, 1, []
    for c in changes:
        if not c:
            counter += 1
        else:
            previous, counter = counter, 1
        out.append((counter, previous))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60))
def test_run_lengths(changes):
    out, _ = RunLength("s", "b").run({"b": np.array(changes)}, [1, 1])
    assert list(zip(out["s_counter"], out["s_previous"])) == runs_by_rows(changes)


def test_decay_keeps_nan():
    out, _ = Decay("s", "x", 0.9).run({"x": np.array([1.0, np.nan, 1.0])}, 0.0)
    assert out["s"][0] == pytest.approx(0.1) and np.isnan(out["s"][1:]).all()


# Lengths of orders side by side: fewer and more than are stepped together, ragged, some of one row.
LENGTHS = st.lists(st.integers(1, 30), min_size=1, max_size=2 * LEAST_LANES + 3)


@pytest.mark.parametrize("scan", [*SCANS, Alarm("s", "x", FOUR, with_state=True)], ids=lambda s: type(s).__name__)
@settings(max_examples=100, deadline=None)
@given(lengths=LENGTHS, seed=st.integers(0, 10_000))
def test_orders_side_by_side_equal_orders_alone(scan, lengths, seed):
    r = np.random.default_rng(seed)
    cols = columns(r.choice([0.0, 1.0, 2.5, 4.0, 6.5, 9.0, np.nan, 0.1], sum(lengths)).tolist())
    lanes = Lanes(np.array(lengths))
    # Some orders come with a state of earlier rows.
    states = [scan.run(columns(r.choice([1.0, 4.0, 9.0], 5).tolist()), scan.initial())[1] if r.random() < 0.5 else scan.initial()
              for _ in lengths]
    got, after = scan.run_lanes(cols, lanes, json.loads(json.dumps(states)))
    for i, (lo, hi) in enumerate(zip(lanes.starts, lanes.ends)):
        out, end = scan.run({n: c[lo:hi] for n, c in cols.items()}, states[i])
        assert json.dumps(after[i]) == json.dumps(end)
        for name in scan.outputs:
            a, b = got[name][lo:hi], out[name]
            assert a.dtype == b.dtype or {a.dtype.kind, b.dtype.kind} <= set("if")
            assert a.tolist() == b.tolist() or np.array_equal(a.astype(float), b.astype(float), equal_nan=True)


def test_steps_and_rest_cover_every_row():
    lanes = Lanes(np.array([3, 9, 1, 4, 9, 2, 5, 30]))
    rows = np.arange(lanes.rows)
    seen = [x for (xs,) in lanes.steps(rows) for x in xs.tolist()] + [x for _, part in lanes.rest() for x in rows[part].tolist()]
    assert sorted(seen) == rows.tolist()
    sizes = [len(xs) for (xs,) in lanes.steps(rows)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == 8 and sizes[-1] >= LEAST_LANES
