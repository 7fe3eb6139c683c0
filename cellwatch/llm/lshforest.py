"""Nearest neighbours by largest inner product with a hash-prefix forest.

Each tree gives a vector a string of sign bits of random projections; vectors are
lengthened by one axis to a common norm, so that the angle to a query falls as the
inner product grows.  A tree is its strings in sorted order.  A query descends each
tree to the longest prefix that it shares with any string, and then all trees ascend
together, a bit at a time, until the strings with the common prefix are enough
candidates.  How many those are is counted in all trees first, so every tree
stops at the same length.  A tree's task scores its candidates with the exact inner product
and returns its best, so candidates are never emitted.

Trees are cut by their strings' first bits into parts of about ``PART_ROWS`` rows; a part
that is still larger (equal or close vectors share all bits) is dealt over several tasks, and each
of them answers for its rows.  Repeated rows and queries are made one before they are
hashed, so they take no places and count no string twice; a row's number tells apart different
vectors of an id.  Queries are rows by contract, their number is the caller's.

``share`` is the part of all rows, over all trees and with repetitions, that a query has to
look at.  Vectors without structure need a large one: at 64 dimensions the twentieth
neighbour of a random vector is hardly nearer than others.  ``measure_recall`` compares with
brute force.

Defined results: vectors that are null, zero, or hold a null or a number that isn't finite
take no part; a shorter vector counts as if zeros followed; a query's own rows (its id)
are no candidates; rows that repeat another id are one candidate each if their vectors differ and
one if not; ties go to the smaller id; with fewer candidates than asked for, all
that were found are returned; null ids are neither queries nor candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cellwatch.llm.shared import stored
from cellwatch.llm.vectors import matrix, rows_of, usable, width

TREES = 32
BITS = 48
NEAREST = 20
SHARE = 1.25
PART_ROWS = 100_000
EVERY = 20
#: Scores in memory at a time.
SCORES = 1 << 21


@dataclass
class Forest:
    """Projections of all trees and the norm that vectors are lengthened to."""

    projections: np.ndarray  # trees x bits x (dimensions + 1)
    norm: float

    @staticmethod
    def random(dimensions: int, norm: float, trees: int, bits: int, seed: int = 5) -> Forest:
        return Forest(np.random.default_rng(seed).standard_normal((trees, bits, dimensions + 1)), norm)

    def strings(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Bit strings as integers, a column for each tree; a query has no part on the added axis."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, self.norm ** 2 - (vectors ** 2).sum(axis=1)))
        longer = np.concatenate([vectors, rest[:, None]], axis=1)
        trees, bits, _ = self.projections.shape
        out = np.zeros((len(vectors), trees), np.int64)
        for t in range(trees):
            signs = (longer @ self.projections[t].T) >= 0
            out[:, t] = signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
        return out


def _different(vectors: DataFrame, label: str) -> DataFrame:
    """``(row, vec_id, embedding)`` of the rows that take part, numbered, repeated ones and zeros at a vector's end left out."""
    found = vectors.select("vec_id", "embedding").where(usable() & F.col("vec_id").isNotNull())
    zeros = F.array_position(F.transform(F.reverse("embedding"), lambda x: x != 0), True) - 1
    found = found.select("vec_id", F.slice("embedding", 1, (F.size("embedding") - zeros).cast("int")).alias("embedding")).distinct()
    return stored(found.withColumn("row", F.monotonically_increasing_id()), label)


def _hashed(rows: DataFrame, forest: Forest, dimensions: int, query: bool) -> DataFrame:
    """``(row, id, tree, bits, vector)`` for each row and tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            vectors = matrix(batch.column("embedding"), dimensions)
            strings = forest.strings(vectors, query)
            trees = strings.shape[1]
            raw = [v.tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([
                *[pa.array(np.repeat(batch.column(c).to_numpy(), trees)) for c in ("row", "vec_id")], pa.array(np.tile(np.arange(trees, dtype=np.int32), len(raw))),
                pa.array(strings.reshape(-1)), pa.array([r for r in raw for _ in range(trees)], pa.binary())],
                ["row", "id", "tree", "bits", "vector"])

    return rows.select("row", "vec_id", "embedding").mapInArrow(work, "row long, id long, tree int, bits long, vector binary")


def _depth_counts(bits: int, cut: int):
    """For each query of a part the number of strings that share its first ``n`` bits, for each ``n`` from ``cut`` on."""

    def work(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        strings, asked = np.sort(index["bits"].to_numpy(np.int64)), queries["bits"].to_numpy(np.int64)
        counts = np.zeros((len(asked), bits - cut + 1), np.int64)
        for n in range(cut, bits + 1):
            low = (asked >> (bits - n)) << (bits - n)
            counts[:, n - cut] = np.searchsorted(strings, low + (1 << (bits - n))) - np.searchsorted(strings, low)
        return pd.DataFrame({"row": queries["row"].to_numpy(np.int64), "counts": pd.Series(list(counts), dtype=object)})

    return work


def _best_of_part(bits: int, dimensions: int, nearest: int):
    """The best candidates of a part for each of its queries: those that share the first ``depth`` bits."""

    def work(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index = index.sort_values(["bits", "id"], ignore_index=True)
        strings, ids, numbers = (index[c].to_numpy(np.int64) for c in ("bits", "id", "row"))
        vectors, asked = rows_of(index, "vector", np.float64, dimensions), rows_of(queries, "vector", np.float64, dimensions)
        names, depth = queries["id"].to_numpy(np.int64), queries["depth"].to_numpy(np.int64)
        low = (queries["bits"].to_numpy(np.int64) >> (bits - depth)) << (bits - depth)
        firsts, lasts = np.searchsorted(strings, low), np.searchsorted(strings, low + (1 << (bits - depth)))
        found: list[tuple[np.ndarray, ...]] = []
        # Queries with the same candidates share a product; a part may have none.
        order = np.lexsort((lasts, firsts))
        edges = np.flatnonzero(np.concatenate([[len(order) > 0], (firsts[order][1:] != firsts[order][:-1]) | (lasts[order][1:] != lasts[order][:-1]), [True]]))
        for start, stop in zip(edges[:-1], edges[1:]):
            first, last = firsts[order[start]], lasts[order[start]]
            together = max(1, SCORES // max(1, last - first))
            for at in range(start, stop, together) if last > first else ():
                some = order[at:min(stop, at + together)]
                rough = asked[some] @ vectors[first:last].T
                for q, scores in zip(some, rough):
                    own = ids[first:last] == names[q]
                    if own.any():
                        scores[own] = -np.inf
                    best = np.arange(len(scores))
                    if len(scores) > nearest:
                        bound = np.partition(scores, -nearest)[-nearest]
                        best = np.flatnonzero(scores >= bound - 1e-9 * max(1.0, abs(bound)))
                    best = best[scores[best] > -np.inf] + first
                    exact = (vectors[best] * asked[q]).sum(axis=1)
                    top = np.lexsort((ids[best], -exact))[:nearest]
                    found.append((np.full(len(top), names[q]), ids[best][top], numbers[best][top], exact[top]))
        return pd.DataFrame({n: np.concatenate(c) if found else np.zeros(0, t) for n, c, t in zip(
            ("query_id", "vec_id", "row", "score"), zip(*found) if found else ((),) * 4, (np.int64, np.int64, np.int64, np.float64))})

    return work


def search(embeddings: DataFrame, queries: DataFrame, nearest: int = NEAREST, share: float = SHARE, trees: int = TREES,
           bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's nearest rows; both have ``vec_id`` and ``embedding``."""
    rows, queries = _different(embeddings, "forest-rows"), _different(queries, "forest-asked")
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"),
        F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("square")).collect()[0]
    count, dimensions = found["n"], max(found["width"] or 0, width(queries))
    forest = Forest.random(dimensions, (found["square"] or 0.0) ** 0.5, trees, bits)
    cut = min(bits, max(0, (count // part_rows).bit_length()))  # bits that parts of a tree share
    index = stored(_hashed(rows, forest, dimensions, False).withColumn("part", F.shiftright("bits", bits - cut)), "forest-index")
    asked = stored(_hashed(queries, forest, dimensions, True).withColumn("part", F.shiftright("bits", bits - cut)), "forest-queries")
    sizes = stored(index.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows")), "forest-sizes")
    sizes = sizes.withColumn("pieces", F.ceil(F.col("rows") / part_rows).cast("int"))
    pieced = index.join(sizes.select("tree", "part", "pieces"), ["tree", "part"]).withColumn(
        "piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))

    def pieces_of(part_queries: DataFrame) -> DataFrame:
        return part_queries.join(sizes.select("tree", "part", "pieces"), ["tree", "part"]).withColumn(
            "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

    place = ["tree", "part", "piece"]
    own = pieced.select(*place, "bits").groupBy(*place).cogroup(pieces_of(asked.select("row", "tree", "part", "bits")).groupBy(*place))
    counts = own.applyInPandas(_depth_counts(bits, cut), "row long, counts array<long>")
    deep = counts.select("row", F.posexplode("counts").alias("depth", "n")).select("row", (F.col("depth") + cut).alias("depth"), "n")
    # Shorter prefixes than a part's: whole parts.
    above = sizes.select("tree", "part", "rows", F.explode(F.sequence(F.lit(0), F.lit(max(0, cut - 1)))).alias("depth")).where(F.lit(cut > 0))
    above = above.select("tree", "depth", F.expr(f"shiftright(part, {cut} - depth)").alias("prefix"), "rows").groupBy("tree", "depth", "prefix").agg(F.sum("rows").alias("n"))
    shallow = asked.select("row", "tree", F.explode(F.sequence(F.lit(0), F.lit(max(0, cut - 1)))).alias("depth"), "part").where(F.lit(cut > 0))
    shallow = shallow.select("row", "tree", "depth", F.expr(f"shiftright(part, {cut} - depth)").alias("prefix")).join(above, ["tree", "depth", "prefix"])
    total = deep.unionByName(shallow.select("row", "depth", "n")).groupBy("row", "depth").agg(F.sum("n").alias("n"))
    enough = max(float(nearest + 1) * 2, share * count)
    depths = total.groupBy("row").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("depth"))), F.lit(0)).alias("depth"))
    deeper = asked.join(stored(depths, "forest-depths"), "row")
    # A prefix that is shorter than a part's takes in all parts below it.
    spread = F.greatest(F.lit(0), F.lit(cut) - F.col("depth"))
    base = F.expr(f"shiftright(part, greatest(0, {cut} - depth))")
    visits = deeper.withColumn("spread", spread).withColumn("base", base).withColumn(
        "part", F.explode(F.expr("sequence(shiftleft(base, spread), shiftleft(base + 1, spread) - 1)"))).drop("spread", "base")
    answers = pieced.select(*place, "row", "id", "bits", "vector").groupBy(*place).cogroup(
        pieces_of(visits).select(*place, "id", "bits", "vector", "depth").groupBy(*place))
    best = answers.applyInPandas(_best_of_part(bits, dimensions, nearest), "query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def queries_of(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    return embeddings.where(F.col("vec_id") % every == 0)


def measure_recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of ``exact``'s rows (``query_id``, ``vec_id``) that ``found`` has."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    return both.count() / max(1, exact.count())
