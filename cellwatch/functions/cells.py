"""Array expressions over the cell voltages and temperatures of one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import LOW_CELL_VOLT
from .parse import pick_extreme

NAN = float("nan")


def repair_low(values: Column, floor: float = LOW_CELL_VOLT) -> Column:
    """Replace cells at or under ``floor`` (or NaN) by the row's largest cell."""
    sound = (F.array_min(values) > floor) & ~F.isnan(F.array_max(values))
    top = F.array_repeat(pick_extreme(values, largest=True), F.size(values))
    mended = F.zip_with(values, top, lambda v, t: F.when((v > floor) & ~F.isnan(v), v).otherwise(t))
    return F.when(sound, values).otherwise(mended)


def index_of(values: Column, item: Column) -> Column:
    """Zero-based first position of ``item``."""
    return F.array_position(values, item) - 1


def mean_without(values: Column, extreme: Column) -> Column:
    """Mean of the other items once ``extreme`` is left out; NaN for a single item."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    rest = F.size(values) - 1
    return F.when(rest > 0, (total - extreme) / rest).otherwise(F.lit(NAN))
