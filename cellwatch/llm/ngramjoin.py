"""Similarity join of documents on word 5-grams by vertical partitioning.

A document is the set of its distinct runs of five words; two link at a Jaccard
similarity of 0.8 or more.  Equal word sequences are one text, told apart by a hash.

The global order of all n-grams (their hashes) is cut into fragments, and each text's
set into a segment per fragment.

1. A fragment gathers its segments from all texts and finds the n-grams that at least two
   texts have.  The number of those is a partial count of the text's overlap with all
   others; the counts are summed per text over the fragments.  A text of which
   less than 80 % is shared links with nothing.  Texts travel in slices: an n-gram that
   several texts of a slice have is counted there and sent once, so an n-gram that
   all documents have costs a fragment one entry a slice.
2. The n-grams of the texts left are ordered from rare to frequent.  Linked texts share
   one of the first ``n - ceil(0.8 n) + 1``; those that no other text has come first and
   need no list.  Each n-gram's texts are paired with the one among them
   that has the fewest n-grams alone.  Pairs are counted exactly: overlaps are
   counted per fragment, and summed per pair.  The links found are contracted to components.
3. Pairs of texts that share such an n-gram, and are in different components, are
   counted as well.  So a large group of near copies costs a few pairs a text, not all,
   and no link between components is lost.

Hashes are 64 bits of an n-gram (``Segments`` keeps 48 and the fragment) and 96 bits of a
text.  A wrong link or count needs two hashes of the same two texts to collide.

Defined results: null and empty texts have no n-grams, no links, and themselves as
component; a text of fewer words is one n-gram, its whole sequence; rows that repeat a doc_id with the
same text are one document, with another text they are two texts whose smallest id is
the same; a null doc_id is passed over when the smallest is taken, and the component is null
if all are; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cellwatch.llm.components import components
from cellwatch.llm.shared import Words, giving_back, mixed, own_column, random_words, slices, stored

WORDS = 5
#: Similarity in hundredths.
SIMILARITY = 80
KEY_BYTES = 12
#: N-grams that a fragment should get, and the least number of fragments.
FRAGMENT_GRAMS = 3_000_000
LEAST_FRAGMENTS = 32
#: Fragments in which the overlap of a pair is counted.
PAIR_FRAGMENTS = 4

_FACTORS = random_words("shingle", WORDS + 1)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """For each row the hash of its word sequence (none without words) and its sorted n-gram hashes."""
    found = Words(column)
    words = found.hashes
    runs = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        runs = sum(words[k:len(words) - WORDS + 1 + k] * _FACTORS[k] for k in range(WORDS))
        runs = mixed(runs)
    for i in range(len(found)):
        low, high = int(found.bounds[i]), int(found.bounds[i + 1])
        if low == high:
            yield None, words[:0]
            continue
        key = hashlib.blake2b(words[low:high].tobytes(), digest_size=KEY_BYTES).digest()
        if high - low >= WORDS:
            yield key, np.unique(runs[low:high - WORDS + 1])
        else:
            whole = np.append(words[low:high] * _FACTORS[:high - low], _FACTORS[WORDS:] * np.uint64(high - low))
            yield key, mixed(whole.sum(dtype=np.uint64, keepdims=True))


def text_keys(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, n)`` per row: the text's key, null without words, and the size of its set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = [(key, len(grams)) for key, grams in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                ["doc_id", "key", "n"])

    schema = StructType([docs.schema["doc_id"], StructField("key", BinaryType()), StructField("n", LongType())])
    return docs.select("doc_id", "text").mapInArrow(giving_back(work), schema)


def _pack(grams: np.ndarray) -> bytes:
    """The low 48 bits of hashes."""
    return np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


#: A slice's segment in a fragment (``part`` below the number of fragments), or its texts and
#: the postings of the n-grams that several of them have (``part`` from that number on).
SEGMENT = ("part int, slice string, keys binary, docs binary, counts binary, grams binary, "
           "shared binary, shared_counts binary")
_SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]


def _slice_segments(column: pa.Array, name: str, bits: int) -> pa.RecordBatch | None:
    """Rows of ``SEGMENT`` for a slice of texts."""
    keys: dict[bytes, int] = {}
    sets = []
    keep = _LOW | ~np.uint64((1 << (64 - bits)) - 1)
    for key, grams in shingle_sets(column):
        if key is not None and key not in keys:
            keys[key] = len(sets)
            sets.append(np.unique(grams & keep))
    if not sets:
        return None
    sizes = np.array([len(s) for s in sets], np.uint32)
    grams = np.concatenate(sets)
    docs = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(grams, kind="stable")
    grams, docs = grams[order], docs[order]
    starts, lengths = _runs(grams)
    several = np.repeat(lengths > 1, lengths)
    shared, shared_counts, postings = grams[starts[lengths > 1]], lengths[lengths > 1].astype(np.uint32), docs[several]
    single, single_docs = grams[~several], docs[~several]
    shift = np.uint64(64 - bits)
    part = (single >> shift).astype(np.int64)
    order = np.argsort(part * len(sets) + single_docs, kind="stable")
    single, single_docs, part = single[order], single_docs[order], part[order]
    shared_part = (shared >> shift).astype(np.int64)
    packed = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES)
    rows = []
    for p in np.union1d(part, shared_part):
        low, high = np.searchsorted(part, [p, p + 1])
        s_low, s_high = np.searchsorted(shared_part, [p, p + 1])
        first, counts = _runs(single_docs[low:high])
        own = single_docs[low:high][first]
        rows.append((int(p), name, packed[own].tobytes(), own.tobytes(), counts.astype(np.uint32).tobytes(),
                     _pack(single[low:high]), _pack(shared[s_low:s_high]), shared_counts[s_low:s_high].tobytes()))
    to = (1 << bits) + int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % (1 << bits)
    rows.append((to, name, packed.tobytes(), postings.tobytes(), sizes.tobytes(), b"", shared.tobytes(), shared_counts.tobytes()))
    kinds = [pa.int32(), pa.string(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _SEGMENT_NAMES)


def segments(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of ``SEGMENT`` of all texts, with ``2 ** bits`` fragments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = _slice_segments(batch.column("text"), f"{partition}/{number}", bits)
            number += 1
            if rows is not None:
                yield rows

    return docs.select("text").mapInArrow(giving_back(work), SEGMENT)


#: What a fragment returns to a slice: its n-grams that other texts have too, each with a rank that
#: grows with its number of texts, and the texts that are copies of a text in an earlier slice.
RETURNED = ("slice string, part int, docs binary, counts binary, grams binary, ranks binary, shared_ranks binary, "
            "copies binary, keys binary, sizes binary, shared binary, shared_counts binary")
_RETURNED_NAMES = [c.split()[0] for c in RETURNED.split(", ")]


def _fragment_counts(bits: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        if part >= 1 << bits:  # on its way through
            rows = rows.rename(columns={"counts": "sizes"}).reindex(columns=_RETURNED_NAMES).astype(object)
            return rows.where(rows.notna(), None)
        rows = rows.sort_values("slice", ignore_index=True)
        docs = [np.frombuffer(x, np.uint16) for x in rows["docs"]]
        counts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["counts"]]
        grams = [_unpack(x) for x in rows["grams"]]
        shared = [_unpack(x) for x in rows["shared"]]
        shared_counts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["shared_counts"]]
        keys = np.frombuffer(b"".join(rows["keys"]), f"V{KEY_BYTES}")
        row_of = np.repeat(np.arange(len(rows)), [len(d) for d in docs])
        _, first, same = np.unique(keys, return_index=True, return_inverse=True)
        is_copy = row_of[first][same] != row_of if len(keys) else np.zeros(0, bool)
        copy_of_gram = np.repeat(is_copy, np.concatenate(counts) if counts else [])
        every = np.concatenate([*grams, *shared])
        weight = np.concatenate([(~copy_of_gram).astype(np.int64), *shared_counts])
        order = np.argsort(every, kind="stable")
        starts, lengths = _runs(every[order])
        total = np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0, np.int64)
        texts = np.empty(len(every), np.int64)
        texts[order] = np.repeat(total, lengths)
        rank = np.minimum(255, 8 * np.log2(np.maximum(1, texts))).astype(np.uint8)
        out, at, at_doc, at_shared = [], 0, 0, sum(map(len, grams))
        for i, name in enumerate(rows["slice"]):
            size = len(grams[i])
            copy = is_copy[at_doc:at_doc + len(docs[i])]
            doc_of = np.repeat(docs[i], counts[i])
            keep = (texts[at:at + size] > 1) & ~np.repeat(copy, counts[i])
            first_kept, kept_counts = _runs(doc_of[keep])
            ranks_shared = rank[at_shared:at_shared + len(shared[i])]
            out.append((name, part, doc_of[keep][first_kept].tobytes(), kept_counts.astype(np.uint32).tobytes(), _pack(grams[i][keep]),
                        rank[at:at + size][keep].tobytes(), ranks_shared.tobytes(), docs[i][copy].tobytes(), None, None, None, None))
            at, at_doc, at_shared = at + size, at_doc + len(docs[i]), at_shared + len(shared[i])
        return pd.DataFrame(out, columns=_RETURNED_NAMES)

    return work


def _shared_sets(bits: int):
    """A slice's texts of which enough is shared, with their shared n-grams from rare to frequent."""
    shift = np.uint64(64 - bits)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows[rows["keys"].notna()]
        if len(texts) != 1:
            raise ValueError(f"slice {rows['slice'].iloc[0]} was cut in two ways")
        texts = texts.iloc[0]
        rows = rows[rows["keys"].isna()].sort_values("part")
        sizes = np.frombuffer(texts["sizes"], np.uint32).astype(np.int64)
        shared, postings = np.frombuffer(texts["shared"], np.uint64), np.frombuffer(texts["docs"], np.uint16)
        shared_counts = np.frombuffer(texts["shared_counts"], np.uint32)
        shared_ranks = np.frombuffer(b"".join(rows["shared_ranks"]), np.uint8)
        docs = [postings, *[np.repeat(np.frombuffer(d, np.uint16), np.frombuffer(c, np.uint32)) for d, c in zip(rows["docs"], rows["counts"])]]
        grams = [np.repeat(shared, shared_counts),
                 *[_unpack(g) | (np.uint64(p) << shift) for g, p in zip(rows["grams"], rows["part"])]]
        ranks = [np.repeat(shared_ranks, shared_counts), np.frombuffer(b"".join(rows["ranks"]), np.uint8)]
        docs, grams, ranks = np.concatenate(docs), np.concatenate(grams), np.concatenate(ranks)
        enough = 100 * np.bincount(docs, minlength=len(sizes)) >= SIMILARITY * sizes
        enough[np.concatenate([np.frombuffer(c, np.uint16) for c in rows["copies"]] or [postings[:0]])] = False
        keep = enough[docs]
        docs, grams, ranks = docs[keep], grams[keep], ranks[keep]
        order = np.lexsort((grams, ranks, docs))
        docs, grams = docs[order], grams[order]
        starts, lengths = _runs(docs)
        keys = texts["keys"]
        return pd.DataFrame({
            "key": pd.Series([keys[KEY_BYTES * d:KEY_BYTES * (d + 1)] for d in docs[starts].tolist()], dtype=object),
            "n": sizes[docs[starts]],
            "grams": pd.Series([grams[s:s + n].view(np.int64) for s, n in zip(starts, lengths)], dtype=object)})

    return work


def candidates(docs: DataFrame, total: int) -> DataFrame:
    """``(id, key, n, grams)``, stored: texts of which 80 % is shared, with their shared n-grams, the rarest first.

    ``total``: the number of n-grams of all rows, for the number of fragments.
    """
    bits = max(LEAST_FRAGMENTS, -(-total // FRAGMENT_GRAMS)) - 1
    bits = bits.bit_length()
    returned = segments(docs, bits).groupBy("part").applyInPandas(_fragment_counts(bits), RETURNED)
    sets = returned.groupBy("slice").applyInPandas(_shared_sets(bits), "key binary, n long, grams array<long>")
    # Copies that share all their n-grams within each slice come from several slices, alike.
    best = sets.groupBy("key").agg(F.max_by(F.struct("n", "grams"), F.size("grams")).alias("best"))
    sets = best.select(F.monotonically_increasing_id().alias("id"), "key", "best.n", "best.grams")
    return stored(sets, "ngram-sets")


def _least(n: str) -> str:
    return f"(({SIMILARITY} * {n} + 99) div 100)"


def _common(n_a: str, n_b: str) -> str:
    """The least number of common n-grams of texts that link."""
    return f"(({SIMILARITY} * ({n_a} + {n_b}) + {99 + SIMILARITY}) div {100 + SIMILARITY})"


def _postings(sets: DataFrame) -> DataFrame:
    """``(gram, id, n, alone, place, short)`` of the n-grams of which linked texts share one.

    ``alone``: n-grams that no other text has; ``place``: the n-gram's in the text's order, those first.  Of a
    pair, the text with fewer n-grams needs a shorter prefix, as at least 160 / 180 of them are common;
    ``short``: the n-gram is in it.
    """
    first = F.expr(f"greatest(0, n - {_least('n')} + 1 - (n - size(grams)))").cast("int")
    listed = sets.select("id", "n", (F.col("n") - F.size("grams")).alias("alone"), F.posexplode(F.slice("grams", F.lit(1), first)).alias("at", "gram"))
    listed = listed.withColumn("place", F.col("alone") + F.col("at"))
    return listed.select("gram", "id", "n", "alone", "place", F.expr(f"place <= n - {_common('n', 'n')}").alias("short"))


def linked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs ``(a, b)`` of texts that link: overlaps counted per fragment, and summed per pair."""
    fragment = F.shiftrightunsigned("gram", 64 - (PAIR_FRAGMENTS - 1).bit_length())
    pieces = sets.select("id", "n", F.explode(F.array(*[F.lit(i) for i in range(PAIR_FRAGMENTS)])).alias("fragment"), "grams")
    pieces = pieces.select("id", "n", "fragment", F.expr(
        f"filter(grams, g -> shiftrightunsigned(g, {64 - (PAIR_FRAGMENTS - 1).bit_length()}) = fragment)").alias("grams"))
    left = pieces.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
    right = pieces.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    counted = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("partial"))
    total = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("overlap"))
    return total.where(f"100 * overlap >= {SIMILARITY} * (n_a + n_b - overlap)").select("a", "b")


def _fit(n_a: str, n_b: str) -> str:
    """Whether sizes allow the similarity."""
    return f"100 * least({n_a}, {n_b}) >= {SIMILARITY} * greatest({n_a}, {n_b})"


#: How well a text stands for others: the fewer n-grams it has alone, the better.
_CENTRAL = ("alone", "id", "n")


def _pairs(frame: DataFrame, pivot: str) -> DataFrame:
    """Pairs ``(a, b)`` of ``id`` and a pivot whose sizes allow the similarity."""
    return (
        frame.where(f"id <> {pivot}.id and {_fit('n', f'{pivot}.n')}")
        .select(F.least("id", f"{pivot}.id").alias("a"), F.greatest("id", f"{pivot}.id").alias("b")).distinct()
    )


def _pivot_pairs(postings: DataFrame) -> DataFrame:
    """Each n-gram's texts with the most central one.

    Near copies may be too unlike each other, and yet each link with what they were made
    from; that has hardly an n-gram alone.
    """
    pivots = postings.groupBy("gram").agg(F.min(F.struct(*_CENTRAL)).alias("pivot"), F.count(F.lit(1)).alias("texts"))
    return _pairs(postings.join(pivots.where("texts > 1").select("gram", "pivot"), "gram"), "pivot")


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of n-grams whose texts are in several components, with their components' ``label``."""
    labelled = postings.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    several = labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return labelled.join(several.select("gram"), "gram", "left_semi")


def _crossing_pairs(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs of texts that share an n-gram, can link by their numbers of n-grams, and are in different components.

    What two texts have in common is at most what either shares with any; and if they have ``c`` n-grams in common
    at least, then one within the first ``n - c + 1`` of both.
    """
    labelled = _labelled(postings, labels)
    left, right = (labelled.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "alone", "place", "short", "label")]) for side in "ab")
    common = _common("n_a", "n_b")
    enough = f"least(n_a - alone_a, n_b - alone_b) >= {common} and place_a <= n_a - {common} and place_b <= n_b - {common}"
    pairs = left.where("short_a").join(right, "gram").where(
        f"(n_a < n_b or n_a = n_b and id_a < id_b) and label_a <> label_b and {_fit('n_a', 'n_b')} and {enough}")
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _of(links: DataFrame) -> DataFrame:
    """``(id, component)`` of linked texts."""
    return components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (``doc_id``, ``text``)."""
    base = stored(text_keys(docs), "ngram-keys")
    total = base.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    sets = candidates(docs, total)
    postings = stored(_postings(sets), "ngram-postings")
    links = stored(linked(sets, _pivot_pairs(postings)), "ngram-links")
    labels = stored(_of(links), "ngram-labels")
    whole = _of(links.unionByName(linked(sets, _crossing_pairs(postings, labels)))).withColumnRenamed("id", "node")
    roots = sets.select("id", "key").join(whole.select(F.col("node").alias("id"), "component"), "id").select("key", "component")
    texts = base.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first")).join(roots, "key", "left")
    smallest = texts.where("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
    texts = texts.join(smallest, "component", "left").select("key", F.coalesce("smallest", "first").alias("component_id"))
    joined = base.join(texts, "key", "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, nulls last; ``docs`` keeps its columns.

    Rows are told apart by doc_id and a hash of all columns; of equal rows one stays.
    """
    key = own_column(docs, "row_key")
    keyed = docs.withColumn(key, F.struct(
        F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash")))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
