"""The safety pipeline: telemetry to fault events, failed orders and carried state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import (
    Config, DEFAULT_GAP, ISC_LEVELS, NEAR_EQUAL_TEMP, PAIR_LEVELS, SOC_DECAY, VOLT_DECAY,
)
from ..operators.ekf import KalmanSoc
from ..operators.features import KEY, features, with_soc
from ..operators.fold import Level, Program, STATE, keyed_fold
from ..operators.scans import Alarm, Before, Decay, LatestMarked, RunLength, SpikeHold, Total
from ..session import scratch_path
from ..sources.grids import Grids
from ..sources.sinks import DAY, read_events, write_events
from ..sources.telemetry import read_telemetry

TIME = "reltime"

# Fixed names and order of the event table.
EVENT_COLUMNS = (
    "reltime", "orderid", "ISC_FAULT", "Cap_dep_FAULT", "Heat_gen_FAULT", "batteryid", "MinVoltage", "TempId",
    "MaxTemp", "DeltaP", "Heat_gen_FAULT_ret", "Cap_dep_FAULT_ret", "ISC_FAULT_ret", "dt",
)


def changed(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows that are not near-equal to the row before; NaN counts as a change."""
    return ~(np.abs(value - before) < NEAR_EQUAL_TEMP)


def positive_gap(now: np.ndarray, before) -> np.ndarray:
    gap = now - before
    return np.where(gap <= 0, DEFAULT_GAP, gap)


def heat_levels(config: Config) -> tuple[Level, Level, Level]:
    """Spike hold, run lengths and filters of the heat power of both temperatures."""

    def marks(c):
        return {
            "max_changed": changed(c["held"], c["held_before"]),
            "avg_changed": changed(c["temp_avg"], c["avg_before"]),
        }

    def filter_inputs(c):
        avg_gap = positive_gap(c["epoch"], c["epoch_before"])
        max_gap = avg_gap if config.fix_pmax_time else positive_gap(c["epoch"], 0)
        with np.errstate(all="ignore"):
            return {
                "max_slope": (c["held"] - c["held_before"]) / max_gap / c["max_run_previous"],
                "avg_slope": (c["temp_avg"] - c["avg_before"]) / avg_gap / c["avg_run_previous"],
                "max_excess": c["held"] - c["temp_ambient"],
                "avg_excess": c["temp_avg"] - c["temp_ambient"],
            }

    keep = config.cell.heat_decay
    return (
        Level(None, (SpikeHold("held", "temp_max"), Before("avg_before", "temp_avg"),
                     Before("epoch_before", "epoch"))),
        Level(marks, (RunLength("max_run", "max_changed"), RunLength("avg_run", "avg_changed"))),
        Level(filter_inputs, tuple(
            Decay(f"{side}_{kind}_filter", f"{side}_{kind}", keep)
            for side in ("max", "avg") for kind in ("slope", "excess"))),
    )


def heat_power(config: Config):
    """Vectorized step from the filters to ``p_max``, ``p_avg`` and ``delta_p``."""
    cell = config.cell

    def power(c, side):
        return (c[f"{side}_slope_filter"] * cell.mass * cell.heat_capacity
                + c[f"{side}_excess_filter"] * cell.convection * cell.area)

    def columns(c):
        p_max, p_avg = power(c, "max"), power(c, "avg")
        return {"p_max": p_max, "p_avg": p_avg, "delta_p": p_max - p_avg}

    return columns


def fault_flags(wtt, wsoc, wv, wt) -> dict:
    """Fault flags of alarm levels; works on numpy arrays."""
    return {
        "isc": (wtt + wsoc + wv + wt >= ISC_LEVELS).astype(np.int32),
        "cap": (wv + wsoc >= PAIR_LEVELS).astype(np.int32),
        "heat": (wt + wtt >= PAIR_LEVELS).astype(np.int32),
    }


def safety_program(config: Config, grids: Grids | None = None) -> Program:
    """The per-order program behind the event table."""
    hold, runs, filters = heat_levels(config)
    drift_source = "delta_v" if config.wtt_input == "delta_v" else "delta_t"

    def flags(c):
        marks = fault_flags(c["wtt"], c["wsoc"], c["wv"], c["wt"])
        return {**filters.prepare(c), **marks, "any": (marks["isc"] + marks["cap"] + marks["heat"]) > 0}

    def codes(c):
        return {f"{f}_ret": np.where(c[f"{f}_total"] > 0, 2, 1).astype(np.int32) for f in ("isc", "cap", "heat")}

    smooth_soc = Decay("delta_soc", "soc_gap", SOC_DECAY)
    direct = (Alarm("wv", "delta_v", config.wv), Alarm("wt", "delta_t", config.wt),
              Decay("drift", drift_source, VOLT_DECAY))
    soc_levels: tuple[Level, ...] = ()
    soc_gap = lambda c: {"soc_gap": c["soc_avg"] - c["soc_min"]}
    inputs = ("epoch", "temp_max", "temp_avg", "temp_ambient", "delta_v", "delta_t", "dt")
    if config.soc_method == "ekf":
        soc_levels = (Level(None, soc_scans(config, grids)),)
        soc_gap = lambda c: {"soc_gap": c["ekf_avg_carried"] - c["ekf_min_carried"]}
        inputs += ("volt_avg", "volt_min", "current")
    else:
        inputs += ("soc_avg", "soc_min")
    power = heat_power(config)
    return Program(
        levels=(
            *soc_levels,
            Level(soc_gap, (*hold.scans, smooth_soc, *direct)),
            Level(runs.prepare, (*runs.scans, Alarm("wsoc", "delta_soc", config.wsoc),
                                 Alarm("wtt", "drift", config.wtt))),
            Level(flags, (*filters.scans, *[Total(f"{f}_total", f) for f in ("isc", "cap", "heat")],
                          LatestMarked("event_dt", "dt", "any"))),
            Level(power, (Alarm("wp", "delta_p", config.wp),)),
        ),
        inputs=inputs,
        text_inputs=("dt",),
        finish=codes,
        outputs={
            **{n: T.IntegerType() for n in (
                "isc", "cap", "heat", "isc_ret", "cap_ret", "heat_ret", "wp", "wsoc", "wtt", "wv", "wt")},
            **{f"{n}_total": T.LongType() for n in ("isc", "cap", "heat")},
            **{n: T.DoubleType() for n in ("delta_p", "p_max", "p_avg", "delta_soc", "drift")},
            "event_dt": T.StringType(),
        },
    )


def soc_scans(config: Config, grids: Grids):
    return (
        KalmanSoc("ekf_avg", "temp_avg", "volt_avg", "current", "epoch", grids, config.cell),
        KalmanSoc("ekf_min", "temp_max", "volt_min", "current", "epoch", grids, config.cell),
    )


def safety_rows(
    telemetry: DataFrame,
    grids: Grids,
    config: Config = Config(),
    tiebreak: Sequence[str] = (),
    states: DataFrame | None = None,
    with_state: bool = False,
    limit: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Every processed row with its alarm levels, fault flags and running codes.

    ``sizes`` is any frame with an ``orderid`` per telemetry row; finding long
    orders counts its keys, by default those of ``telemetry`` itself.
    """
    feats = with_soc(features(telemetry, tuple(tiebreak)), grids)
    sizes = telemetry if sizes is None else sizes
    return fold_features(feats, grids, config, tiebreak, states, with_state, limit, sizes)


def fold_features(
    feats: DataFrame, grids: Grids, config: Config = Config(), tiebreak: Sequence[str] = (),
    states: DataFrame | None = None, with_state: bool = False, limit: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    return keyed_fold(
        feats, safety_program(config, grids), KEY, [TIME, *tiebreak],
        carry=[*tiebreak, TIME, "dt", "batteryid", "volt_min", "temp_id", "temp_max"],
        sizes=sizes, limit=limit, states=states, with_state=with_state)


def event_columns(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The event table's columns; the date is that of the latest faulty row so far."""
    return rows.select(
        *extra,
        "reltime", "orderid",
        F.col("isc").alias("ISC_FAULT"), F.col("cap").alias("Cap_dep_FAULT"), F.col("heat").alias("Heat_gen_FAULT"),
        "batteryid",
        F.col("volt_min").alias("MinVoltage"), F.col("temp_id").alias("TempId"), F.col("temp_max").alias("MaxTemp"),
        F.col("delta_p").alias("DeltaP"),
        F.col("heat_ret").alias("Heat_gen_FAULT_ret"), F.col("cap_ret").alias("Cap_dep_FAULT_ret"),
        F.col("isc_ret").alias("ISC_FAULT_ret"),
        F.col("event_dt").alias("dt"),
    )


def fault_events(telemetry: DataFrame, grids: Grids, config: Config = Config(), **options) -> DataFrame:
    """Fault events of telemetry, ready for the event table."""
    return event_columns(safety_rows(telemetry, grids, config, **options))


def failed_orders(feats: DataFrame) -> DataFrame:
    """Orders with an unusable row, with the first reason by name; rows without an order count as one such."""
    error = F.when(F.col(KEY).isNull(), F.lit("orderid missing")).otherwise(F.col("error"))
    return feats.withColumn("error", error).where(F.col("error").isNotNull()).groupBy(KEY).agg(F.min("error").alias("error"))


@dataclass(frozen=True)
class RunResult:
    """Tables a run has written, as lazily readable frames.

    ``events`` is the whole event table; ``failed`` and ``states`` belong to
    the run.  Pass ``states`` to the run of the next range.  ``failed`` and
    ``states`` are read from the run's folder in the shared folder; ``close``
    removes it once they are written elsewhere or no longer needed.
    """

    events: DataFrame
    failed: DataFrame
    states: DataFrame
    work: str

    def close(self) -> None:
        spark = self.events.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.work)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_batch(
    spark: SparkSession,
    source: str,
    target: str,
    start: str,
    end: str,
    grids: Grids,
    config: Config = Config(),
    tiebreak: Sequence[str] = (),
    states: DataFrame | None = None,
    mode: str = "overwrite",
    limit: int | None = None,
) -> RunResult:
    """Process a date range once and write its events.

    The raw telemetry, much wider than its features, is read and parsed a
    single time: everything else works on the feature table this writes to the
    shared folder.
    """
    telemetry = read_telemetry(spark, source, start, end)
    work = scratch_path(spark, "run")
    with_soc(features(telemetry, tuple(tiebreak)), grids).write.parquet(f"{work}/features")
    feats = spark.read.parquet(f"{work}/features")
    fold_features(feats, grids, config, tiebreak, states, with_state=True, limit=limit,
                  sizes=feats.select(KEY)).write.parquet(f"{work}/folded")
    folded = spark.read.parquet(f"{work}/folded")
    rows = folded.where(F.col(STATE).isNull())
    events = event_columns(rows, (*tiebreak, F.col("dt").alias(DAY)))
    write_events(events, target, mode, (start, end))
    return RunResult(
        events=read_events(spark, target, events.schema),
        failed=failed_orders(feats),
        states=folded.where(F.col(STATE).isNotNull()).select(KEY, STATE),
        work=work,
    )
