"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Every anchor looks for rows in *windows* of scores: first the best rows of its own label
(the positives), then, for each positive, the best rows of other labels that score
between a share of the positive's score and that score itself.

A join runs over blocks of rows and chunks of anchors, each pair of them in a task.  In a
block, dimensions go by falling energy.  The inverted index of a row holds its leading
dimensions only: those that follow are left out as soon as the norm of the row's rest
times the largest norm of an anchor's rest falls below ``COVERED`` of the lowest
threshold, which the rest then cannot reach by itself.  Rows are sorted by how much of them is
indexed, so the posting list of a dimension is a prefix of the block, and partial scores
accumulate dimension by dimension over these lists.  A pair whose partial score plus the
product of both remaining norms stays below the anchor's threshold is dropped; what is
left is scored exactly, in integers.

Thresholds start high.  Windows that stay unfilled are joined again at lower ones, the
last being the window's own lower end (for positives: none), so results are exact whatever
the thresholds are.  A task gives at most the wanted number of rows per window.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part, nor do those with a component beyond 2**16, whose scores may
not fit an integer; of rows with equal ids the one with the smallest label, then smallest
vector, takes part; shorter vectors count as if zeros followed; zero vectors take part;
ties go to the smaller id; an anchor without positives, a positive below zero, and a
window without rows have no rows in the result.  Other columns are not looked at.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellwatch.llm.shared import stored

SCALE = 256.0
LARGEST = 1 << 24
ANCHOR_EVERY, FLIP_EVERY, LABELS = 100, 7, 10
WANTED = 5
#: A negative scores at least this many hundredths of its positive.
LEAST_PERCENT = 80
#: Rows of a block, anchors of a chunk, and pairs that are held at a time.
BLOCK, CHUNK, PAIRS = 4096, 1024, 1 << 21
#: Part of the threshold that what is left out of the index may reach.
COVERED = 0.5
#: Thresholds of positives, as parts of the anchor's norm times the mean norm; then none.
LEVELS = (0.6, 0.4, 0.2, 0.0)
#: Thresholds of negatives, as parts of the positive's score; then the window's own end.
NEGATIVE_LEVELS = (0.95, 0.88)
#: Allowance for the rounding of bounds, as a part of both norms' product.
SLACK = 1e-9
#: A window's upper or lower end where it has none.
HIGHEST = 1 << 62


def prepared(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, q)`` with noisy labels and whole-number vectors, one row per id."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    flipped = F.when(F.col("vec_id") % FLIP_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), flipped.alias("label"), scaled.alias("q"))
    rows = rows.where(F.forall("q", lambda x: F.abs(x) <= LARGEST))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row"))
    return one.select("vec_id", "row.label", F.col("row.q").alias("q"))


def _energies(rows: DataFrame) -> np.ndarray:
    """Sum of squares of each dimension, in falling order the index's order."""
    width = rows.agg(F.max(F.size("q")).alias("n")).collect()[0]["n"] or 0
    if not width:
        return np.zeros(0)
    square = [F.sum(F.pow(F.coalesce(F.get("q", F.lit(i)), F.lit(0)).cast("double"), F.lit(2.0))).alias(f"s{i}") for i in range(width)]
    return np.array([x or 0.0 for x in rows.agg(*square).collect()[0]])


def _packed(rows: DataFrame, order: np.ndarray) -> DataFrame:
    """Vectors as bytes of 32-bit integers, dimensions in the index's order."""
    width = len(order)

    def work(frames):
        for frame in frames:
            q = np.zeros((len(frame), width), np.int32)
            for i, x in enumerate(frame["q"]):
                q[i, :len(x)] = x
            q = q[:, order]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "q": [r.tobytes() for r in q]})

    return rows.mapInPandas(work, "vec_id long, label long, q binary")


def _vectors(frame: pd.DataFrame, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(frame), 0), np.int64)
    return np.frombuffer(b"".join(frame["q"]), np.int32).reshape(len(frame), width).astype(np.int64)


def _rest_norms(q: np.ndarray) -> np.ndarray:
    """Norm of what follows, from each dimension on; 0 after the last."""
    squares = np.cumsum((q.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(q), 1))], axis=1))


class Index:
    """A block's rows, longest indexed part first, with the posting lists of their leading dimensions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, rest_of_anchors: np.ndarray, least: float):
        rest = _rest_norms(q)
        # Dimensions that must be indexed; a row needs none from where its rest is covered on.
        open_ = rest * rest_of_anchors > COVERED * least if least > 0 else np.ones(rest.shape, bool)
        open_[:, -1] = False
        indexed = open_.sum(axis=1)
        order = np.argsort(-indexed, kind="stable")
        self.ids, self.labels, self.q, self.indexed = ids[order], labels[order], q[order], indexed[order]
        self.rest, self.norm = rest[order, self.indexed], rest[order, 0]
        self.by_dimension = np.ascontiguousarray(self.q.T.astype(np.float64))
        #: Rows in each dimension's posting list.
        self.counts = np.searchsorted(-self.indexed, -np.arange(q.shape[1]), side="left")

    def partial_scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of anchors and rows over the indexed dimensions."""
        scores = np.zeros((len(x), len(self.ids)))
        start, width = 0, len(self.counts)
        while start < width and self.counts[start]:
            stop = start + 1
            while stop < width and self.counts[stop] == self.counts[start]:
                stop += 1
            n = self.counts[start]
            scores[:, :n] += x[:, start:stop] @ self.by_dimension[start:stop, :n]
            start = stop
        return scores

    def candidates(self, q: np.ndarray, rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an anchor and a row that may reach the anchor's threshold ``least``."""
        bound = self.partial_scores(q.astype(np.float64)) + rest[:, self.indexed] * self.rest
        return np.nonzero(bound + SLACK * rest[:, :1] * self.norm + SLACK >= least[:, None])


def _first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of each group's best scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    first = np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < most]


def _join(anchors: DataFrame, rows: DataFrame, width: int, same_label: bool, keys: list[str]) -> DataFrame:
    """The best ``WANTED`` rows of each window within each block.

    ``anchors``: ``anchor_id, label, q, wins`` (an array of structs ``win, high, low``);
    ``rows``: ``vec_id, label, q``; both with the columns ``keys``.
    """
    schema = "anchor_id long, win long, vec_id long, score long"

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(left) and len(right):
            aq, anchor_ids, labels = _vectors(left, width), left["anchor_id"].to_numpy(), left["label"].to_numpy()
            windows = [[(w["win"], w["high"], w["low"]) for w in ws] for ws in left["wins"]]
            slots = max(map(len, windows))
            # An anchor with fewer windows than others has empty ones, which nothing fits.
            table = np.array([[*ws, *[(-1, -HIGHEST, HIGHEST)] * (slots - len(ws))] for ws in windows], np.int64)
            low = table[:, :, 2].min(axis=1)
            rest = _rest_norms(aq)
            index = Index(right["vec_id"].to_numpy(), right["label"].to_numpy(), _vectors(right, width),
                          rest.max(axis=0), float(low.min()))
            step = max(1, PAIRS // len(index.ids))
            for at in range(0, len(left), step):
                part = slice(at, at + step)
                i, j = index.candidates(aq[part], rest[part], low[part].astype(np.float64))
                i += at
                if same_label:
                    keep = (labels[i] == index.labels[j]) & (anchor_ids[i] != index.ids[j])
                else:
                    keep = labels[i] != index.labels[j]
                i, j = i[keep], j[keep]
                score = np.concatenate([np.einsum("ij,ij->i", aq[i[k:k + 65536]], index.q[j[k:k + 65536]])
                                        for k in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
                for slot in range(slots):
                    fits = np.flatnonzero((score <= table[i, slot, 1]) & (score >= table[i, slot, 2]))
                    best = fits[_first_of_each(i[fits], score[fits], index.ids[j[fits]], WANTED)]
                    found.append(pd.DataFrame({"anchor_id": anchor_ids[i[best]], "win": table[i[best], slot, 0],
                                               "vec_id": index.ids[j[best]], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_id", "win", "vec_id", "score")})

    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(work, schema)


def _spread(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), column), parts)


def _best(found: DataFrame) -> DataFrame:
    """The best rows of each window over all blocks, with ``rank``."""
    order = Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= WANTED)


def _dealt(anchors: DataFrame, rows: DataFrame, blocks: Column, chunks: Column) -> tuple[DataFrame, DataFrame]:
    """Each anchor once for each block, each row once for each chunk of anchors."""
    anchors = anchors.withColumn("chunk", _spread("anchor_id", chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("block", _spread("vec_id", blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    long = [F.col(c).cast("long").alias(c) for c in ("block", "chunk")]
    return (anchors.select("anchor_id", "label", "q", "wins", *long), rows.select("vec_id", "label", "q", *long))


def positives(anchors: DataFrame, rows: DataFrame, width: int, mean_norm: float) -> DataFrame:
    """``(anchor_id, positive_id, positive_score)``: the best rows of each anchor's own label.

    A label's rows are cut into as many blocks as they need; anchors meet blocks of their label only.
    """
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    sizes = stored(sizes.join(counts, "label").select(
        "label", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("m") / CHUNK).alias("chunks")), "label-sizes")
    there = rows.join(sizes, "label")
    left, done = anchors.join(sizes, "label"), None
    for level in (*LEVELS, None):
        low = F.lit(-HIGHEST) if level is None else F.ceil(F.col("norm") * (level * mean_norm))
        asked = left.withColumn("wins", F.array(F.struct(
            F.lit(0).cast("long").alias("win"), F.lit(HIGHEST).alias("high"), low.cast("long").alias("low"))))
        found = stored(_best(_join(*_dealt(asked, there, F.col("blocks"), F.col("chunks")), width, True, ["label", "block", "chunk"])),
                       "positives")
        filled = found.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("found"))
        if level is None:
            kept = found
        else:
            kept = found.join(filled.where(F.col("found") == WANTED).select("anchor_id"), "anchor_id", "left_semi")
            left = stored(left.join(filled.where(F.col("found") == WANTED), "anchor_id", "left_anti"), "anchors")
        done = kept if done is None else done.unionByName(kept)
        if level is not None and left.isEmpty():
            break
    return done.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def negatives(anchors: DataFrame, rows: DataFrame, found_positives: DataFrame, width: int) -> DataFrame:
    """The first rows of other labels in each positive's window.

    All rows are cut into blocks of mixed labels, and each anchor's windows are joined together.
    """
    n, m = rows.count(), anchors.count()
    blocks, chunks = F.lit(max(1, ceil(n / BLOCK))), F.lit(max(1, ceil(m / CHUNK)))
    score = F.col("positive_score")
    # Whole numbers at or above LEAST_PERCENT hundredths of the score.
    least = F.expr(f"(positive_score * {LEAST_PERCENT} + 99) div 100")
    left, done = found_positives.where(score >= 0).withColumn("least", least), None
    for level in (*NEGATIVE_LEVELS, None):
        low = F.col("least") if level is None else F.greatest(F.col("least"), F.ceil(score * level).cast("long"))
        asked = left.withColumn("low", low)
        wins = asked.groupBy("anchor_id").agg(F.collect_list(F.struct(
            F.col("positive_id").alias("win"), score.alias("high"), F.col("low"))).alias("wins"))
        found = _best(_join(*_dealt(anchors.join(wins, "anchor_id"), rows, blocks, chunks), width, False, ["block", "chunk"]))
        found = stored(found.withColumnRenamed("win", "positive_id"), "negatives")
        full = found.groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("found"))
        state = asked.join(full, ["anchor_id", "positive_id"], "left")
        settled = (F.col("found") == WANTED) | (F.col("low") <= F.col("least"))
        closed = state.where(F.coalesce(settled, F.col("low") <= F.col("least"))).select("anchor_id", "positive_id", "positive_score")
        done_now = found.join(closed, ["anchor_id", "positive_id"])
        done = done_now if done is None else done.unionByName(done_now)
        if level is None:
            break
        left = stored(state.where(~F.coalesce(settled, F.col("low") <= F.col("least"))).select(*left.columns), "windows")
        if left.isEmpty():
            break
    return done.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def mine(embeddings: DataFrame, anchors: Column | None = None) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` (a condition on ``vec_id``) holds."""
    whole = stored(prepared(embeddings), "vectors")
    energies = _energies(whole)
    width = len(energies)
    rows = stored(_packed(whole, np.argsort(-energies, kind="stable")), "packed")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    mean_norm = float(whole.agg(F.avg(norm).alias("m")).collect()[0]["m"] or 0.0)
    anchors = F.col("vec_id") % ANCHOR_EVERY == 0 if anchors is None else anchors
    norms = whole.where(anchors).select("vec_id", norm.alias("norm"))
    chosen = stored(rows.where(anchors).join(norms, "vec_id").withColumnRenamed("vec_id", "anchor_id"), "anchors")
    return negatives(chosen, rows, stored(positives(chosen, rows, width, mean_norm), "positives"), width)


def oracle_sql() -> str:
    """All pairs of an anchor and a row, for vectors of equal lengths."""
    return f"""
    with rows as (
      select vec_id, case when vec_id % {FLIP_EVERY} = 0 then (label + 1) % {LABELS} else label end as label,
        list_transform(embedding, lambda x: floor({SCALE}::double * x::double)) as q
      from embeddings
      where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (
      select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
      from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % {ANCHOR_EVERY} = 0),
    positives as (
      select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {WANTED})
    select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score, score as negative_score
    from positives join pairs using (anchor_id)
    where not same and {LEAST_PERCENT} * positive_score <= 100 * score and score <= positive_score
    window w as (partition by anchor_id, positive_id order by score desc, vec_id)
    qualify row_number() over w <= {WANTED}
    """
