"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is coded as its words in lower case, each with a space behind it, and an end.  Each
byte is eight binary decisions.  For every order in ``ORDERS`` a predictor looks up the
slot of the last bytes and has the counts with which each bit went either way there in the
training texts; its vote is the logarithm of their ratio.  Votes are mixed by a weighted
sum whose weight set is picked by the bit's place and by how often the longest context was
seen; a table from the mixed vote's strength to how often such votes were right refines the
probability.  Weights and table are *online*: they are updated after each ``CHUNK`` bytes of
a text from what came, and used from the next byte on, so each probability depends on
earlier bytes alone.  Every text starts from the same fitted weights and table, so its score
does not depend on the texts beside it.

Counts are tables that grow with the corpus.  Texts are put into slices, in compressed blocks; a
slice gives its counts of each distinct word and context once, dealt into buckets by hash; a
bucket's task adds up the counts and answers each slice that has asked; one task scores a
slice with its answers.  Buckets are as many as the corpus is long.  Slots that end in the same
``SHARED`` bytes of context lie in one bucket.

The weights that all texts start with, and the table, are fitted to every byte of every
training text, less that byte's own count.  Bytes after the same longest context have the same
votes, so a bucket's entries of the longest order with their counts stand for them, in any
text.  Newton's method finds the weights of least loss; each round adds up the buckets' losses,
slopes and curvatures.  No table is broadcast and none reaches the driver but these sums, some
hundred numbers, and the counts of pairs of bytes (65,536 at most), which each bucket needs.

Beside it stands the base: words and the end as tokens, each with its smoothed frequency.

Defined results: a null text is empty and has one token, the end; rows that repeat a doc_id
are scored each by itself; a null doc_id is neither held out nor learned from; without
training texts every bit has probability 1/2 until the weights learn better, and the base is
0; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.langid import bucket
from cellwatch.llm.shared import Words, _LOWER, giving_back, giving_back_of_group, giving_back_of_pair, mixed, slices, stored

#: Bytes of context of each predictor, the longest last.
ORDERS = (1, 3, 5)
LONGEST = ORDERS[-1]
FOLDS, HELD_OUT = 10, 0
#: Bytes of text in a slice, and in a block of it.
SLICE, PIECE = 32 << 20, 1 << 20
#: Bytes of text for which there is a bucket of words and slots.
BUCKET = 8 << 20
#: Bytes between two updates of the weights, and texts that are coded side by side.
CHUNK, LANES = 256, 64
#: Counts of the longest context from which on another weight set is used.
LEVELS = (1, 8)
SETS = len(LEVELS) + 1
#: Added to each count.
SMALL = 0.4
#: Step of the weights, and votes that the refining table starts with.
RATE, PRIOR = 0.02, 200.0
#: The refining table has so many steps of vote strength, of this size.
STEPS, STEP = 24, 0.5
#: Strongest vote, and the least share of right or wrong votes.
STRONGEST, LEAST = 11.99, 1e-5
#: Most rounds of the fit, the share of the loss from which on a gain is worth one, and how strongly weights are held to their first values.
FIT_ROUNDS, FIT_GAIN, FIT_PULL = 12, 1e-7, 1.0
#: Grams that are fitted to at a time.
FIT_PIECE = 1 << 15
#: Bytes of context by which slots are dealt into buckets; contexts that are shorter are shared by all.
SHARED = 3
END, SPACE = 0x0A, 0x20
#: Tokens' smoothing in the base.
BASE = 0.1


def lines(column: pa.Array) -> pa.Array:
    """The coded form of each text: ends for a context, words with a space behind each, an end."""
    words = Words(column)
    lengths, n = words.ends - words.starts, len(words)
    lowered = _LOWER[words.data]
    of = np.repeat(np.arange(n), np.diff(words.bounds))
    out = np.full(int(lengths.sum()) + len(lengths) + n * (LONGEST + 1), SPACE, np.uint8)
    after = np.concatenate([[0], np.cumsum(lengths + 1)])
    into = after[:-1] + (of + 1) * LONGEST + of
    done = np.cumsum(lengths) - lengths
    every = np.arange(int(lengths.sum()))
    out[np.repeat(into - done, lengths) + every] = lowered[np.repeat(words.starts - done, lengths) + every]
    ends = after[words.bounds[1:]] + np.arange(1, n + 1) * LONGEST + np.arange(n)
    starts = np.concatenate([[0], ends[:-1] + 1]) if n else ends
    out[ends] = END
    out[(starts[:, None] + np.arange(LONGEST)).ravel()] = END
    offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


BLOCKS = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())),
                    ("sizes", pa.list_(pa.int32())), ("packed", pa.binary())])


def _sliced(docs: DataFrame) -> DataFrame:
    """Blocks of compressed lines; slices are numbered by task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        pack = zstandard.ZstdCompressor()
        for batch in (part for whole in batches for part in slices(whole, "text", PIECE)):
            line = lines(batch.column("text"))
            offsets = np.frombuffer(line.buffers()[1], np.int32)
            if held > SLICE:
                number, held = number + 1, 0
            held += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([batch.column("train").to_pylist()], pa.list_(pa.bool_())), pa.array([np.diff(offsets)], pa.list_(pa.int32())),
                pa.array([pack.compress(line.buffers()[2])], pa.binary())], schema=BLOCKS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "train", "text").mapInArrow(
        giving_back(work), "slice long, ids array<long>, train array<boolean>, sizes array<int>, packed binary")


class Block:
    """A block's documents: ids, whether they are learned from, and lines."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, i: int):
        self.number = rows.column("slice")[i].as_py()
        self.ids = rows.column("ids")[i].values
        self.train = rows.column("train")[i].values.to_numpy(zero_copy_only=False).astype(bool)
        sizes = rows.column("sizes")[i].values.to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        packed = rows.column("packed")[i].as_buffer()
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(offsets[-1]))
        self.lines = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        self.coded = Coded(self.lines)

    def words(self) -> Words:
        return Words(self.lines.cast(pa.string()))


class Coded:
    """Consecutive lines: the last ``LONGEST + 1`` bytes at each coded byte, and the lines' bounds among these."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        grams = data[LONGEST:].astype(np.uint64)
        for i in range(1, LONGEST + 1):
            grams |= data[LONGEST - i:len(data) - i].astype(np.uint64) << np.uint64(8 * i)
        inside = np.ones(len(grams), bool)
        starts = offsets[1:-1] - offsets[0]
        for i in range(LONGEST):
            inside[starts - LONGEST + i] = False
        self.grams = grams[inside].view(np.int64)
        self.bounds = offsets - offsets[0] - LONGEST * np.arange(len(offsets))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def entries_of(grams: np.ndarray, order: int) -> np.ndarray:
    """Order, context and next byte of each gram as one number; without its last byte it is the slot."""
    return (grams & ((1 << (8 * (order + 1))) - 1)) | (order << 56)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers and their counts, compressed: steps between numbers, bytes of equal weight side by side."""
    steps = np.diff(keys, prepend=np.int64(0))
    both = np.concatenate([steps, counts.astype(np.int64)]).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(both).tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    both = np.ascontiguousarray(data.reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


CONTENTS = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("words", pa.binary()), ("entries", pa.binary())])


class _Seen:
    """Words and grams of a slice so far."""

    def __init__(self, number: int):
        self.number = number
        self.parts: dict[str, list] = {"words": [], "grams": []}

    def add(self, kind: str, keys: np.ndarray, train: np.ndarray) -> None:
        """``train``: whether each is from a training text, and so counts."""
        for own, weight in ((keys[train], 1), (keys[~train], 0)):
            found, counts = _distinct(own)
            self.parts[kind].append((found, counts * weight))
        if len(self.parts[kind]) > 16:
            self.parts[kind] = [self.merged(kind)]

    def merged(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*[np.concatenate(x) for x in zip(*self.parts[kind])])

    def rows(self, buckets: int) -> pa.RecordBatch:
        """A row for each bucket of words and of slots."""
        grams, counts = self.merged("grams")
        entries = [_summed(entries_of(grams, order), counts) for order in ORDERS]
        dealt = []
        for keys, n, slots in ((*self.merged("words"), False), (*[np.concatenate(x) for x in zip(*entries)], True)):
            dealt_by = keys >> 8 & ((1 << (8 * SHARED)) - 1) if slots else keys
            of = (mixed(dealt_by.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")  # keys stay in order within a bucket
            ends = np.searchsorted(of[order], np.arange(1, buckets))
            dealt.append([packed(k, c) for k, c in zip(np.split(keys[order], ends), np.split(n[order], ends))])
        return pa.RecordBatch.from_arrays([
            pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, self.number)),
            *[pa.array(d, pa.binary()) for d in dealt]], schema=CONTENTS)


def _contents(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each slice and bucket its distinct words and entries with their training counts; 0 where it only asks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for block in (Block(batch, i) for batch in batches for i in range(batch.num_rows)):
            if seen is None or seen.number != block.number:
                if seen is not None:
                    yield seen.rows(buckets)
                seen = _Seen(block.number)
            seen.add("grams", block.coded.grams, np.repeat(block.train, np.diff(block.coded.bounds)))
            words = block.words()
            seen.add("words", words.hashes.view(np.int64), np.repeat(block.train, np.diff(words.bounds)))
        if seen is not None:
            yield seen.rows(buckets)

    return blocks.mapInArrow(giving_back(work), "bucket int, slice long, words binary, entries binary")


class Places:
    """Places of numbers in a sorted list of distinct ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.uint64(64 - max(8, min(23, int(len(keys)).bit_length() + 3)))
        self.table = np.zeros(1 << (64 - int(self.bits)), np.int32)
        self.table[self._slots(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> self.bits).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self.table[self._slots(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        if len(missed):
            there = np.minimum(np.searchsorted(self.keys, keys[missed]), len(self.keys) - 1)
            at[missed] = np.where(self.keys[there] == keys[missed], there, -1)
        return at


@dataclass
class Mixer:
    """Weights (set, bit, predictor) and the refining table (bit, step) as the share of right votes."""

    weights: np.ndarray
    table: np.ndarray

    @staticmethod
    def initial() -> "Mixer":
        strength = (np.arange(STEPS) + 0.5) * STEP
        return Mixer(np.full((SETS, 8, len(ORDERS)), 0.4, np.float32), np.tile(1 / (1 + np.exp(-strength)), (8, 1)).astype(np.float32))


def votes(grams: np.ndarray, entries: np.ndarray, counts: np.ndarray, own: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each gram, the votes for its bits (gram, bit, predictor), and the number of its weight set.

    ``entries`` (sorted) and ``counts`` say how often a next byte followed a context.  A vote is positive
    where the counts speak for the bit that came.  ``own`` is how often a gram itself is left out of the counts.
    """
    sums = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((len(grams), 8, len(ORDERS)), np.float32)
    level = np.zeros(len(grams), np.int8)
    for k, order in enumerate(ORDERS):
        mine = entries_of(grams, order)
        asked, back = (mine, None) if order == LONGEST else np.unique(mine, return_inverse=True)
        # How many went the way of the byte's first j bits, j = 0 ... 8.
        way = []
        for j in range(9):
            low = (asked >> (8 - j)) << (8 - j)
            way.append(sums[np.searchsorted(entries, low + (1 << (8 - j)))] - sums[np.searchsorted(entries, low)] - own)
        found = np.stack([np.log((way[j + 1] + SMALL) / (way[j] - way[j + 1] + SMALL)) for j in range(8)], axis=1)
        out[:, :, k] = found if back is None else found[back]
        if order == LONGEST:
            level[:] = np.searchsorted(np.array(LEVELS), way[0], side="right")
    return out, level


def code(ids: np.ndarray, bounds: np.ndarray, seen: np.ndarray, level: np.ndarray, start: Mixer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Natural logarithms of the texts' probabilities, and what the mixer has learned at each text's end.

    ``ids`` are the grams' places, those of text ``i`` from ``bounds[i]`` to ``bounds[i + 1]``; ``seen`` and ``level`` come from
    ``votes``.  Texts are lanes; all lanes of a step code their next ``CHUNK`` bytes with their own weights.
    """
    lengths, k, usual = np.diff(bounds), len(ORDERS), SETS - 1
    total, flat = np.zeros(len(lengths)), seen.reshape(len(seen), 8 * k)
    final = np.tile(start.weights, (len(lengths), 1, 1, 1))
    right_sums, all_sums = np.zeros((8, STEPS)), np.zeros((8, STEPS))
    by_length = np.argsort(-lengths, kind="stable")
    bit, pick = np.arange(8)[:, None], np.arange(8 * k).reshape(8, k)
    for first in range(0, len(by_length), LANES):
        lanes = by_length[first:first + LANES]
        weights = np.tile(start.weights, (len(lanes), 1, 1, 1))
        right = np.tile(start.table * PRIOR, (len(lanes), 1, 1)).astype(np.float64)
        tried = np.full((len(lanes), 8, STEPS), PRIOR)
        for at in range(0, int(lengths[lanes[0]]), CHUNK):
            n = int(np.searchsorted(-lengths[lanes], -at, side="left"))  # lanes whose text goes on
            size = min(CHUNK, int(lengths[lanes[0]]) - at)
            left = lengths[lanes[:n]] - at
            here = np.arange(size) < left[:, None]
            gram = ids[bounds[lanes[:n], None] + at + np.minimum(np.arange(size), left[:, None] - 1)]
            x, sets = np.take(flat, gram, axis=0), level[gram]
            matrix = np.zeros((n, 8 * k, 8), np.float32)
            matrix[:, pick, bit] = weights[:n, usual]
            z = np.ascontiguousarray(np.matmul(x, matrix).transpose(0, 2, 1))  # quicker than turning x
            lane, byte = np.nonzero(sets != usual)
            if len(lane):
                rare, of = x[lane, byte].reshape(-1, 8, k), sets[lane, byte]
                z[lane, :, byte] = (rare * weights[lane, of]).sum(axis=2)
            np.minimum(z, np.float32(STRONGEST), out=z)  # quicker than clip
            np.maximum(z, np.float32(-STRONGEST), out=z)
            p = np.exp(-z)
            p += 1
            np.reciprocal(p, out=p)
            # The refining table: how often votes of this strength were right; below zero, wrong.
            share = np.clip(right[:n] / tried[:n], LEAST, 1 - LEAST).astype(np.float32)
            signed = np.concatenate([1 - share[:, :, ::-1], share], axis=2)
            cell = (z * np.float32(1 / STEP) + np.float32(STEPS)).astype(np.int64)
            cell += (np.arange(n * 8) * (2 * STEPS)).reshape(n, 8, 1)
            refined = signed.reshape(-1)[cell]
            if not z.all():
                refined[z == 0] = 0.5
            refined += p
            product = refined[:, 0] * refined[:, 1]
            for i in range(2, 8):
                product *= refined[:, i]
            logs = np.log(product) - np.float32(8 * np.log(2))
            miss = 1 - p
            full = here.all()
            if not full:
                logs, miss, cell = logs * here, miss * here[:, None], np.where(here[:, None], cell, n * 16 * STEPS)
            total[lanes[:n]] += logs.sum(axis=1, dtype=np.float64)
            # What came updates weights and table, for the bytes that follow.
            rate = np.float32(RATE / np.sqrt(CHUNK))
            if len(lane):
                missed = miss[lane, :, byte]
                miss[lane, :, byte] = 0
                np.add.at(weights, (lane, of), rate * missed[:, :, None] * rare)
            weights[:n, usual] += rate * np.matmul(miss, x)[:, bit, pick]
            came = np.bincount(cell.ravel(), minlength=n * 16 * STEPS + 1)[:n * 16 * STEPS].reshape(n, 8, 2 * STEPS)
            right[:n] += came[:, :, STEPS:]
            tried[:n] += came[:, :, STEPS:] + came[:, :, STEPS - 1::-1]
        final[lanes] = weights
        right_sums += right.sum(axis=0) - len(lanes) * PRIOR * start.table
        all_sums += tried.sum(axis=0) - len(lanes) * PRIOR
    return total, final, right_sums, all_sums


@dataclass
class Sums:
    """Over grams, by weight set and bit: the loss, its slope and its curvature, and by step, right votes and all."""

    loss: np.ndarray
    slope: np.ndarray
    curve: np.ndarray
    right: np.ndarray
    tried: np.ndarray

    @staticmethod
    def none() -> "Sums":
        k = len(ORDERS)
        return Sums(*[np.zeros(shape) for shape in ((SETS, 8), (SETS, 8, k), (SETS, 8, k, k), (SETS, 8, STEPS), (SETS, 8, STEPS))])

    def add(self, seen: np.ndarray, level: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> None:
        """Grams that came ``counts`` times; ``seen`` and ``level`` come from ``votes``."""
        for s in range(SETS):
            mine = np.flatnonzero((level == s) & (counts > 0))
            x, n = np.ascontiguousarray(seen[mine].transpose(1, 2, 0)), counts[mine].astype(np.float64)  # (bit, predictor, gram)
            z = np.matmul(weights[s, :, None].astype(np.float32), x)[:, 0]
            odds = np.exp(-np.clip(z, -STRONGEST, STRONGEST))
            miss = odds / (1 + odds)
            self.loss[s] += np.log1p(odds) @ n
            change = x * (n.astype(np.float32) * miss)[:, None]
            self.slope[s] += change.sum(axis=2, dtype=np.float64)
            self.curve[s] += np.matmul(change * (1 - miss)[:, None], x.transpose(0, 2, 1))
            step = np.minimum(np.abs(z) / np.float32(STEP), STEPS - 1).astype(np.int64) + np.arange(8)[:, None] * STEPS
            every = np.broadcast_to(n, z.shape)
            self.right[s] += np.bincount(step.ravel(), (every * (z >= 0)).ravel(), 8 * STEPS).reshape(8, STEPS)
            self.tried[s] += np.bincount(step.ravel(), every.ravel(), 8 * STEPS).reshape(8, STEPS)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()])

    @staticmethod
    def of(flat: np.ndarray) -> "Sums":
        shapes = [x.shape for x in vars(Sums.none()).values()]
        parts = np.split(flat, np.cumsum([math.prod(shape) for shape in shapes])[:-1])
        return Sums(*[part.reshape(shape) for part, shape in zip(parts, shapes)])


def searched(sums_at: Callable[[np.ndarray], Sums]) -> Mixer:
    """The mixer of least loss; ``sums_at`` adds up all grams' sums with given weights."""
    first, found = Mixer.initial(), Sums.none()
    start = first.weights.astype(np.float64)
    at, step, found.loss[:] = start.copy(), np.zeros_like(start), np.inf
    for _ in range(FIT_ROUNDS):
        weights = at + step
        sums = sums_at(weights)
        away = weights - start
        sums.loss += FIT_PULL / 2 * (away ** 2).sum(axis=2)
        sums.slope -= FIT_PULL * away
        sums.curve += FIT_PULL * np.eye(len(ORDERS))
        better = sums.loss <= found.loss
        at[better] = weights[better]
        for mine, other in zip(vars(found).values(), vars(sums).values()):
            mine[better] = other[better]
        newton = np.linalg.solve(sums.curve, sums.slope[..., None])[..., 0]
        step = np.where(better[..., None], newton, step / 2)  # a step that went too far is halved
        if (found.slope * step).sum() <= 2 * FIT_GAIN * found.loss.sum():
            break
    table = (found.right.sum(axis=0) + 8 * first.table) / (found.tried.sum(axis=0) + 8)
    return Mixer(at.astype(np.float32), table.astype(np.float32))


def fit(ids: np.ndarray, bounds: np.ndarray, seen: np.ndarray, level: np.ndarray) -> Mixer:
    """The mixer fitted to texts at hand, given as for ``code``."""
    counts = np.bincount(ids, minlength=len(level))

    def sums_at(weights: np.ndarray) -> Sums:
        sums = Sums.none()
        sums.add(seen, level, counts, weights)
        return sums

    return searched(sums_at)


#: The slice of a bucket's row that answers the fit.
CORPUS = -1
ANSWERS = pa.schema([("slice", pa.int64()), ("words", pa.binary()), ("entries", pa.binary()), ("n", pa.int64()), ("firsts", pa.int64())])


def _answers(contents: DataFrame) -> DataFrame:
    """For each slice and bucket the corpus's counts of its words, and of all entries of its slots.

    For ``CORPUS`` and each bucket, of all its entries.
    ``n`` are the slice's own training words there; of the slices that have a word one counts it among its ``firsts``.
    """

    def work(rows: pa.Table) -> pa.Table:
        out = {"slice": np.append(rows.column("slice").to_numpy(), CORPUS)}
        parts = [unpacked(raw.as_buffer()) for raw in rows.column("words")]
        sizes = [len(k) for k, _ in parts]
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        found, first, back = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.bincount(back, counts, minlength=len(found)).astype(np.int64)
        of = np.repeat(np.arange(len(parts)), sizes)
        out["firsts"] = np.bincount(of[first[sums > 0]], minlength=len(parts) + 1)
        out["n"] = np.bincount(of, counts, minlength=len(parts) + 1).astype(np.int64)
        totals, ends = sums[back], np.cumsum(sizes)[:-1]
        out["words"] = [packed(k[t > 0], t[t > 0]) for k, t in zip(np.split(keys, ends), np.split(totals, ends))] + [None]
        parts = [unpacked(raw.as_buffer()) for raw in rows.column("entries")]
        entries, sums = _summed(*[np.concatenate(x) for x in zip(*parts)])
        entries, sums = entries[sums > 0], sums[sums > 0]
        slots, starts, lengths = np.unique(entries >> 8, return_index=True, return_counts=True)
        out["entries"] = []
        for keys, _ in parts:
            at = np.searchsorted(slots, np.unique(keys >> 8))
            asked = np.unique(keys >> 8)
            at = at[(at < len(slots)) & (slots[np.minimum(at, len(slots) - 1)] == asked)] if len(slots) else at[:0]
            n = lengths[at]
            every = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out["entries"].append(packed(entries[every], sums[every]))
        out["entries"].append(packed(entries, sums))
        return pa.table(out).select(ANSWERS.names).cast(ANSWERS)

    return contents.groupBy("bucket").applyInArrow(giving_back_of_group(work), "slice long, words binary, entries binary, n long, firsts long")


class Knowledge:
    """A slice's answers: entries with counts, and words with counts."""

    def __init__(self, answers: pa.Table):
        def whole(column: str) -> tuple[np.ndarray, np.ndarray]:
            parts = [unpacked(x.as_buffer()) for x in answers.column(column)] or [(np.zeros(0, np.int64),) * 2]
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            # A slice that two tasks have read asks twice.
            keys, at = np.unique(keys, return_index=True)
            return keys, counts[at]

        (self.words, self.word_counts), (self.entries, self.counts) = whole("words"), whole("entries")


def _prepared(blocks: pa.Table, known: Knowledge):
    """A slice's blocks, and places and votes of its distinct grams."""
    blocks = blocks.combine_chunks()
    grams, _ = _summed(*[np.concatenate(x) for x in zip(*[_distinct(Block(blocks, i).coded.grams) for i in range(blocks.num_rows)])])
    return (Block(blocks, i) for i in range(blocks.num_rows)), Places(grams), *votes(grams, known.entries, known.counts)


def _pairs(corpus: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The entries of order 1 and their counts: pairs of bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in (x for batch in batches for x in batch.column("entries")):
            entries, counts = unpacked(raw.as_buffer())
            mine = slice(0, int(np.searchsorted(entries, 2 << 56)))
            yield pa.RecordBatch.from_arrays([pa.array(entries[mine]), pa.array(counts[mine])], ["entry", "count"])

    rows = corpus.mapInArrow(giving_back(work), "entry long, count long").toArrow().sort_by("entry")
    return rows.column("entry").to_numpy(), rows.column("count").to_numpy()


def _fitted(corpus: DataFrame) -> Mixer:
    """The mixer fitted to all training texts; ``corpus`` has the entries of each bucket."""
    pairs, pair_counts = _pairs(corpus)

    def sums_at(weights: np.ndarray) -> Sums:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums.none()
            for raw in (x for batch in batches for x in batch.column("entries")):
                entries, counts = unpacked(raw.as_buffer())
                mine = entries >> 56 >= SHARED
                entries, counts = np.append(pairs, entries[mine]), np.append(pair_counts, counts[mine])
                for at in range(int(np.searchsorted(entries, LONGEST << 56)), len(entries), FIT_PIECE):
                    grams = entries[at:at + FIT_PIECE] & ((1 << (8 * (LONGEST + 1))) - 1)
                    sums.add(*votes(grams, entries, counts, own=1), counts[at:at + FIT_PIECE], weights)
            flat = sums.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

        found = corpus.mapInArrow(giving_back(work), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        flat = Sums.none().flat()
        for row in found:
            flat[row["place"]] = row["value"]
        return Sums.of(flat)

    return searched(sums_at)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("known_words", pa.int64()), ("word_logs", pa.float64()),
                    ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())])


def _scores(blocks: DataFrame, answers: DataFrame, mixer: Mixer, whole: float) -> DataFrame:
    """A row for each text: its words, the sum of the logarithms of their smoothed frequencies, and its score.

    ``whole`` is what frequencies are taken of.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return RESULT.empty_table()
        known = Knowledge(right)
        words, logs = Places(known.words), np.log10((np.append(known.word_counts, 0) + BASE) / whole)
        blocks, places, seen, level = _prepared(left, known)
        out = []
        for block in blocks:
            n, in_words = len(block.ids), block.words()
            at, of = words.find(in_words.hashes.view(np.int64)), np.repeat(np.arange(n), np.diff(in_words.bounds))
            total, *_ = code(places.find(block.coded.grams), block.coded.bounds, seen, level, mixer)
            size = np.diff(block.coded.bounds)
            out.append(pa.RecordBatch.from_arrays([
                block.ids, pa.array(np.diff(in_words.bounds)), pa.array(np.bincount(of[at >= 0], minlength=n)),
                pa.array(np.bincount(of, logs[at], minlength=n)), pa.array(total / np.log(10)), pa.array(size),
                pa.array(-total / np.log(2) / size)], schema=RESULT))
        return pa.Table.from_batches(out, RESULT)

    return blocks.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        giving_back_of_pair(work), "doc_id long, n_words long, known_words long, word_logs double, score double, n_bytes long, bits_per_byte double")


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(bucket(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all texts, learned from those that are not held out."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = F.col("doc_id").isNotNull() & ~is_held_out()
    blocks = stored(_sliced(docs.withColumn("train", train)), "blocks")
    known = blocks.agg(
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("bytes"),
        F.sum(F.size(F.filter("train", lambda t: t))).alias("ends")).collect()[0]
    ends = known["ends"] or 0
    answers = stored(_answers(_contents(blocks, math.ceil((known["bytes"] or 1) / BUCKET))), "answers")
    words = answers.agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts")).collect()[0]
    tokens, kinds = (words["n"] or 0) + ends, (words["firsts"] or 0) + int(ends > 0)
    whole = tokens + BASE * (kinds + 1)
    mixer = _fitted(stored(answers.where(F.col("slice") == CORPUS).select("entries"), "corpus"))
    scored = _scores(blocks, answers.where(F.col("slice") != CORPUS), mixer, whole)
    return scored.select(
        "doc_id", is_held_out().alias("held_out"), (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known_words") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("word_logs") + F.lit(math.log10((ends + BASE) / whole))).alias("base_score"), "score", "n_bytes", "bits_per_byte")
