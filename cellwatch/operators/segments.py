"""Orders too long for one task, cut into segments.

Orders are hash-partitioned while each fits a task.  Longer ones are found by a
count per key, and only their rows are range-partitioned by key and row order,
which spreads one order over as many tasks as its length asks for.  Segments of few
rows share a task, so that tasks grow with the rows and not with the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle, split_rows

SEGMENT = "segment_no"
#: Rows that a task of cut orders has at least.
TASK_ROWS = 100_000
#: Bits of a segment's number that count within a task; those above are the task's number.
COUNT_BITS = 33
#: A frame of one row per long order or segment is broadcast up to this many rows, and else joined as it comes.
MOST_BROADCAST_ROWS = 20_000


def listed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it is known to have few rows."""
    return F.broadcast(df) if rows <= MOST_BROADCAST_ROWS else df


def task_of_segment() -> Column:
    """The number of the task that cut a segment; those of one order and task are numbered without gaps."""
    return F.shiftright(SEGMENT, COUNT_BITS)


@dataclass
class Split:
    """``short`` rows of orders that fit one task; ``long`` rows cut by ``SEGMENT``.

    Within a partition of ``long``, rows are sorted by key and row order, and
    every segment lies in one partition and has at most ``limit`` rows.  ``long`` is None when no order is
    long.  ``keys`` are the long orders: fewer than rows / limit of them.
    ``bound`` is at least the number of segments, and so of long orders.
    """

    short: DataFrame
    long: DataFrame | None
    keys: DataFrame | None
    bound: int = 0


def split_long(
    rows: DataFrame, key: str, order: list[str], sizes: DataFrame | None = None, limit: int | None = None
) -> Split:
    """Separate and cut the orders with more than ``limit`` rows.

    ``sizes`` is a frame with the same rows per key that is cheaper to count.
    """
    limit = split_rows(rows.sparkSession, limit)
    counts = (sizes if sizes is not None else rows).groupBy(key).agg(F.count("*").alias("rows"))
    keys = settle(counts.where(F.col("rows") > limit))
    total, count = keys.agg(F.sum("rows"), F.count("*")).first()
    if not total:
        return Split(rows, None, None)
    parts = max(2, ceil(total / max(limit, TASK_ROWS)))
    # Each part counts its segments from its first row; an order's end and the next one's start may share one.
    bound = ceil(total / limit) + parts + count
    names = listed(keys.select(F.col(key).alias("long_key")), bound)
    is_long = F.col(key).eqNullSafe(F.col("long_key"))  # rows without a key are one order
    at = F.col("at")  # part and, in the lower bits, row
    cut = (
        rows.join(names, is_long, "left_semi")
        .repartitionByRange(parts, key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn(SEGMENT, F.shiftleft(F.shiftright(at, COUNT_BITS), COUNT_BITS)
                    + F.floor(at.bitwiseAND((1 << COUNT_BITS) - 1) / limit))
        .drop("at")
    )
    return Split(rows.join(names, is_long, "left_anti"), settle(cut), keys, bound)
