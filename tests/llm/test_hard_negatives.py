"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwatch.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Rows as the operator sees them, then every pair."""
    seen = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) or abs(x) >= 65536 for x in vector):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in vector]
        seen[vec_id] = min(seen.get(vec_id, (99, [])), ((label + 1) % 10 if vec_id % 7 == 0 else label, q))
    out = []
    for anchor, (label, q) in seen.items():
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), i, own) for i, (own, p) in seen.items() if i != anchor)
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score]
            out += [(anchor, positive, k, s[1], -score, -s[0]) for k, s in enumerate(fits[:5], 1)]
    return sorted(out)


def got(table, **options):
    return sorted(tuple(r) for r in hardneg.mine(table, **options).collect())


def random_rows(seed, n, width, labels=10):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    x = centres[r.integers(0, 12, n)] + r.normal(size=(n, width)) * r.choice([0.05, 0.5, 2.0], (n, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), [float(np.float32(v)) for v in row], int(r.integers(0, labels))) for i, row in enumerate(x)]


@pytest.mark.parametrize("labels", [1, 2, 10])
def test_equals_all_pairs(spark, labels):
    rows = random_rows(labels, 1200, 16, labels)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_blocks_and_chunks_do_not_matter(spark, monkeypatch):
    rows = random_rows(5, 1500, 8)
    table = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(hardneg, "BLOCK", 100)
    monkeypatch.setattr(hardneg, "CHUNK", 2)
    assert got(table) == brute(rows)


def test_copies_and_ties(spark):
    r = np.random.default_rng(6)
    few = r.integers(-1, 2, (4, 6)) / 4
    rows = [(i, few[0 if i % 3 else i % 4].tolist(), i % 5) for i in range(900)]
    table = spark.createDataFrame(rows + rows[:300], SCHEMA)
    assert got(table) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(7, 350, 6)
    rows += [(400, [0.0] * 6, 1), (500, [-1.0] * 6, 3), (500, [-2.0] * 6, 3), (500, [9.0], 4), (600, None, 1), (601, [1.0] * 6, None),
             (700, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (701, [nan] * 6, 1), (702, [inf] * 6, 1), (None, [1.0] * 6, 1), (703, [], 1),
             (704, [1e30] * 6, 1), (800, [0.5], 1), (900, [65535.0] * 6, 4), (1000, [1.0] * 9, 77), (-100, [0.1] * 6, 2)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("Label_", F.lit("own")).withColumn("score", F.lit(1)).withColumn("block", F.lit(1))
    assert got(table) == brute(rows)
    assert got(table.limit(0)) == []
    assert got(table.where("vec_id = 100")) == []
    assert got(table.where("vec_id in (703, 400)")) == brute([r for r in rows if r[0] in (703, 400)])


def test_index_leaves_dimensions_out_and_loses_no_pair():
    r = np.random.default_rng(8)
    q = np.floor(256 * r.normal(size=(500, 32)) * np.linspace(1.5, 0.05, 32)).astype(np.int64)
    anchors = q[:40]
    rest = hardneg._rest_norms(anchors)
    scores = anchors @ q.T
    least = np.sort(scores, axis=1)[:, -10].astype(float)
    index = hardneg.Index(np.arange(500), np.zeros(500), q, rest.max(axis=0), least.min())
    assert index.indexed.max() < 32 and index.counts[-1] == 0
    i, j = index.candidates(anchors, rest, least)
    found = set(zip(i.tolist(), index.ids[j].tolist()))
    assert all((a, b) in found for a, b in zip(*np.nonzero(scores >= least[:, None])))
    assert len(found) < 0.5 * scores.size
