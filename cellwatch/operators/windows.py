"""Running columns of an order, on built-in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT_GAP, NEAR_EQUAL_TEMP, SOC_MAX_GAP
from .timeline import Timeline

FAULTS = ("isc", "cap", "heat")


def row_numbers(line: Timeline) -> DataFrame:
    return line.row_number("row_number").table()


def gaps(line: Timeline, epoch: str = "epoch") -> DataFrame:
    """Seconds since the previous row, as the SOC side and the heat side see them."""
    elapsed = F.col(epoch) - F.col("epoch_before")
    return line.before("epoch_before", epoch, 0).with_column(
        "soc_gap", F.when((elapsed > SOC_MAX_GAP) | (elapsed <= 0), DEFAULT_GAP).otherwise(elapsed)
    ).with_column("heat_gap", F.when(elapsed <= 0, DEFAULT_GAP).otherwise(elapsed)).table()


def run_lengths(line: Timeline, value: str) -> DataFrame:
    """Length of the near-equal run up to each row, and of the run before it.

    A run starts at a changed row.  An order begins inside a run that started
    one row earlier, because its first row is compared with 0.
    """
    line.before("value_before", value, 0.0).with_column(
        "changed", ~(F.abs(F.col(value) - F.col("value_before")) < NEAR_EQUAL_TEMP)
        | F.isnan(F.col(value) - F.col("value_before")))
    line.row_number("rn").with_column("change_at", F.when(F.col("changed"), F.col("rn")))
    line.latest("start", "change_at").latest("start_before", "change_at", upto=-1)
    line.with_column("ended", F.when(F.col("changed"), F.col("rn") - F.coalesce("start_before", F.lit(0))))
    return line.latest("ended_last", "ended").table().withColumns({
        "counter": F.col("rn") - F.coalesce("start", F.lit(0)) + 1,
        "counter_delay": F.coalesce("ended_last", F.lit(1)),
    }).drop("value_before", "changed", "rn", "change_at", "start", "start_before", "ended", "ended_last")


def running_faults(line: Timeline) -> Timeline:
    """Fault totals so far."""
    for fault in FAULTS:
        line.running_sum(f"{fault}_total", fault)
    return line


def fault_codes(totals: DataFrame) -> DataFrame:
    """2 once an order has had the fault, 1 before."""
    return totals.withColumns({f"{f}_ret": F.when(F.col(f"{f}_total") > 0, 2).otherwise(1) for f in FAULTS})


def latest_fault_date(line: Timeline) -> DataFrame:
    """Date of the latest row with any fault, before that of the first row."""
    faulty = sum((F.col(f) for f in FAULTS), F.lit(0)) > 0
    line.with_column("fault_dt", F.when(faulty, F.col("dt")))
    line.latest("latest_dt", "fault_dt").first("first_dt", "dt")
    return line.table().withColumn("event_dt", F.coalesce("latest_dt", "first_dt")).drop(
        "fault_dt", "latest_dt", "first_dt")


def fault_rates(faults: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Faults per row of an order, where skipped rows count as rows."""
    totals = faults.groupBy(key).agg(*[F.sum(f).alias(f"{f}_total") for f in FAULTS])
    rows = sizes.groupBy(key).agg(F.count("*").alias("rows"))
    return totals.join(rows, key).select(
        key, "rows", *[(F.col(f"{f}_total") / F.col("rows")).alias(f"{f}_rate") for f in FAULTS])


def running_fault_rates(totals: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Add the faults so far per row of the whole order, where skipped rows count as rows."""
    rows = sizes.groupBy(key).agg(F.count("*").alias("rows"))
    return totals.join(rows, key).withColumns({f"{f}_rate": F.col(f"{f}_total") / F.col("rows") for f in FAULTS}).drop("rows")
