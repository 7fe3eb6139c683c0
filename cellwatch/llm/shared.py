"""Helpers of the operators: intermediate tables, Arrow slices, word hashes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cellwatch.session import scratch_path

#: Text bytes that a Python worker turns into numpy columns at a time.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: lineage ends here."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_column(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``most`` bytes of ``column`` each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        stop = min(stop, start + 60_000)
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return freed memory to the system; a Python worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(work: Work) -> Work:
    """``work`` of ``mapInArrow``, with freed memory returned before and after a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from work(batches)
        give_back()

    return run


def giving_back_of_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``work`` of a group's ``applyInArrow``, with freed memory returned before and after each group."""
    def run(rows: pa.Table) -> pa.Table:
        give_back()
        found = work(rows)
        give_back()
        return found

    return run


def giving_back_of_pair(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a pair of groups."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        found = work(left, right)
        give_back()
        return found

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(label: str, count: int) -> np.ndarray:
    """``count`` fixed odd 64-bit numbers that depend on ``label`` alone."""
    raw = b"".join(hashlib.blake2b(f"{label}/{i}".encode(), digest_size=8).digest() for i in range(count))
    return np.frombuffer(raw, np.uint64) | np.uint64(1)


_BYTE_VALUES = random_words("byte", 256)
_BASE = int(random_words("base", 1)[0])
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers = tuple(
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column, A-Z lower-cased, as 64-bit hashes.

    Of kind ``alphanumeric``: runs of ASCII letters and digits and all other characters
    beyond ASCII, capitals of Latin-1 lower-cased as well.

    ``hashes`` and ``starts`` (byte positions in the slice) run over all words; the
    words of row ``i`` are those from ``bounds[i]`` to ``bounds[i + 1]``.  Equal words
    get equal hashes; unequal ones collide with a probability of about 2**-64.
    """

    def __init__(self, column: pa.Array, kind: str = "plain"):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        n = len(self.data)
        lowered = _LOWER[self.data]
        if kind == "alphanumeric":
            inside = _ALPHANUMERIC[self.data]
            after_c3 = np.flatnonzero(self.data[:-1] == 0xC3) + 1
            capital = after_c3[(self.data[after_c3] <= 0x9E) & (self.data[after_c3] != 0x97)]
            lowered[capital] += 0x20
        else:
            inside = ~_SPACE[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.concatenate([np.zeros(1, bool), inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], np.zeros(1, bool)]) if n else inside
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        powers, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[lowered] * powers[:n], out=sums[1:])
        spread = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        self.hashes = mixed(spread + (self.ends - self.starts).astype(np.uint64))
        self._sums = sums
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes; 0 for words that aren't longer."""
        stop = np.minimum(self.starts + size, len(self._sums) - 1)
        _, inverse = _power_tables(len(self._sums))
        spread = (self._sums[stop] - self._sums[self.starts]) * inverse[self.starts]
        return np.where(self.ends - self.starts > size, mixed(spread ^ np.uint64(size << 56)), np.uint64(0))
