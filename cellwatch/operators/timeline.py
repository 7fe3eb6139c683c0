"""Window functions over each order's rows, also for orders too long for one task.

Short orders use plain windows.  A long order is cut into segments; a window
runs inside each segment, and what the segment needs to know of the rows before
it comes from one row per earlier segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .segments import SEGMENT, listed, split_long


class Timeline:
    """Rows in order, to which running columns are added one by one.

    ``order`` must identify a row within its key.  ``sizes`` is a frame with the
    same rows per key that is cheaper to count than ``rows``.
    """

    def __init__(self, rows: DataFrame, key: str, order: list[str],
                 sizes: DataFrame | None = None, limit: int | None = None):
        split = split_long(rows, key, order, sizes, limit)
        self.key, self.order = key, order
        self.short, self.long, self.bound = split.short, split.long, split.bound

    def _add(self, name: str, running: Callable, part: Column, combine: Callable, joined: Callable) -> "Timeline":
        """Add a column.

        ``running(window)`` is its value from the rows of the window alone.  Of
        a segment, ``part`` is kept; ``combine`` turns the parts of earlier
        segments into what is carried in; ``joined(local, carried)`` is the
        value within a segment.
        """
        self.short = self.short.withColumn(name, running(Window.partitionBy(self.key).orderBy(*self.order)))
        if self.long is not None:
            local = Window.partitionBy(self.key, SEGMENT).orderBy(*self.order)
            earlier = Window.partitionBy(self.key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
            parts = self.long.groupBy(self.key, SEGMENT).agg(part.alias("part"))
            carried = parts.select(F.col(self.key).alias("of_key"), F.col(SEGMENT).alias("of_segment"),
                                   combine(F.col("part")).over(earlier).alias("carried"))
            same = F.col(self.key).eqNullSafe(F.col("of_key")) & (F.col(SEGMENT) == F.col("of_segment"))
            self.long = settle(
                self.long.join(listed(carried, self.bound), same, "left")
                .withColumn("first_row", F.row_number().over(local) == 1)
                .withColumn(name, joined(running(local), F.col("carried")))
                .drop("of_key", "of_segment", "carried", "first_row"))
        return self

    def with_column(self, name: str, value: Column) -> "Timeline":
        """Add a column that depends on the row alone."""
        self.short = self.short.withColumn(name, value)
        if self.long is not None:
            self.long = self.long.withColumn(name, value)
        return self

    def row_number(self, name: str) -> "Timeline":
        return self._add(
            name,
            lambda w: F.row_number().over(w),
            F.count("*"),
            F.sum,
            lambda local, carried: (local + F.coalesce(carried, F.lit(0))).cast("int"))

    def running_sum(self, name: str, column: str) -> "Timeline":
        return self._add(
            name,
            lambda w: F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.sum(column),
            F.sum,
            lambda local, carried: local + F.coalesce(carried, F.lit(0)))

    def before(self, name: str, column: str, default) -> "Timeline":
        """Value of the previous row; ``default`` on an order's first row."""
        return self._add(
            name,
            lambda w: F.lag(column, 1, default).over(w),
            F.max_by(F.struct(F.col(column).alias("v")), F.struct(*self.order)),
            F.last,
            lambda local, carried: F.when(F.col("first_row") & carried.isNotNull(), carried["v"]).otherwise(local))

    def latest(self, name: str, column: str, upto: int = 0) -> "Timeline":
        """Latest non-null value up to this row, or with ``upto=-1`` up to the one before."""
        return self._add(
            name,
            lambda w: F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, upto)),
            F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*self.order))),
            lambda part: F.last(part, ignorenulls=True),
            lambda local, carried: F.coalesce(local, carried))

    def first(self, name: str, column: str) -> "Timeline":
        """Value of the order's first row."""
        return self._add(
            name,
            lambda w: F.first(column).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.min_by(F.struct(F.col(column).alias("v")), F.struct(*self.order)),
            F.first,
            lambda local, carried: F.when(carried.isNotNull(), carried["v"]).otherwise(local))

    def table(self) -> DataFrame:
        if self.long is None:
            return self.short
        return self.short.unionByName(self.long.drop(SEGMENT))
