"""The registered queries: one per operator, on telemetry derived from the given tables.

Every query keeps ``event_id`` as row identity, or the order for per-order
results, and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..config import Config, FourLevel, SOC_DECAY, VOLT_DECAY
from ..functions import cells as C
from ..functions.interp import interp_1d, lookup, lower_node, with_location
from ..functions.parse import epoch_list, epoch_of_text, highest, scalar_or_list, with_lists
from ..operators import features as S1, windows
from ..operators.fold import Level, Program, STATE, keyed_fold
from ..operators.scans import Alarm, Decay, SpikeHold
from ..operators.timeline import Timeline
from ..session import scratch_path
from ..sources.grids import read_grids, sample_grid_table, sample_grids, write_grids
from ..sources.sinks import DAY, read_events, write_events
from ..sources.telemetry import between_dates, derived_telemetry, order_sizes
from . import safety

Query = Callable[[SparkSession, str], DataFrame]

KEY = S1.KEY
ORDER = ["reltime", "event_id"]
TIE = ("event_id",)
RANGE = ("2024-01-05", "2024-01-12")
RESUME_AT = "2024-01-15"
SECOND_END = "2024-01-19"
#: Thresholds of the four-level alarm query, on the scale of ``events.value``.
VALUE_ALARM = FourLevel(rise=(20.0, 40.0, 60.0, 80.0), settle=(15.0, 35.0, 55.0, 75.0), clear=(10.0, 30.0, 50.0, 70.0))
VALUE_DECAY = 0.9


def r6(col: Column | str) -> Column:
    return F.round(col, 6)


def r6_all(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


# --- sources -----------------------------------------------------------------

def scan_date_range(spark, sf):
    return between_dates(derived_telemetry(spark, sf), *RANGE).select("event_id", KEY, "dt", "cell_min_volt")


def stored_grids(spark):
    """The sample grids by way of a stored grid table."""
    path = scratch_path(spark, "grids")
    write_grids(sample_grid_table(spark), path)
    return read_grids(spark, path)


def grid_load(spark, sf):
    """Per telemetry row a node of each of the stored and loaded grids, all nodes in turn; tau is mirrored."""
    grids = stored_grids(spark)

    def node(name: str) -> Column:
        flat = [float(z) for row in grids.tables[name] for z in row]
        return F.element_at(F.array(*map(F.lit, flat)), (F.col("event_id") % len(flat) + 1).cast("int"))

    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", *[F.round(node(n), 9).alias(n.lower()) for n in grids.tables])


def sink_roundtrip(spark, sf):
    """Events written twice to the same table, then read back: no row appears twice."""
    path, rows = scratch_path(spark, "events"), scratch_path(spark, "rows")
    _fault_rows(spark, sf).write.parquet(rows)
    events = safety.event_columns(spark.read.parquet(rows), ("event_id", F.col("dt").alias(DAY)))
    write_events(events, path)
    write_events(events, path)
    return read_events(spark, path).groupBy(DAY).agg(
        F.count("*").alias("rows"), F.countDistinct("event_id").alias("events"),
        F.sum("Cap_dep_FAULT").alias("cap_total"))


# --- parsing and filters -----------------------------------------------------

def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def cast_double(spark, sf):
    text = derived_telemetry(spark, sf).withColumns({
        "cell_min_volt": F.when(_every(19), "n/a").when(_every(23), "[3.4]")
        .otherwise(F.col("cell_min_volt").cast("string")),
        "cell_max_tem": F.when(_every(29), "").otherwise(F.col("cell_max_tem").cast("string")),
    })
    return S1.cast_pack_columns(text).select("event_id", "cell_min_volt", "cell_max_tem")


def null_skip(spark, sf):
    rows = S1.drop_incomplete(S1.cast_pack_columns(derived_telemetry(spark, sf)))
    return rows.select("event_id", "cell_min_volt", "cell_max_tem")


def _joined(column: str, digits: int) -> Column:
    """All items of an array as text: whole numbers of the last digit, so that engines write them alike."""
    return F.array_join(F.transform(column, lambda x: F.round(x * 10 ** digits).cast("long").cast("string")), ",", "null")


def parse_cells(spark, sf):
    text = (F.when(_every(29), "[3.1, x]").when(_every(31), "").when(_every(37), "[[1],2]")
            .when(_every(41), " [3.4 , ,3.5]").when(_every(43), "[3.4d, 3.5]").otherwise(F.col("bmv_singlevolt")))
    cells = with_lists(derived_telemetry(spark, sf).select("event_id", text.alias("text")), {"cells": "text"})
    return cells.select("event_id", F.coalesce(F.size("cells"), F.lit(-1)).alias("n_cells"), _joined("cells", 4).alias("cells"))


def scalar_or_list_query(spark, sf):
    rows = derived_telemetry(spark, sf)
    volt = F.when(_every(5), F.col("bmv_singlevolt")).otherwise(F.col("cell_max_volt").cast("string"))
    temp = F.when(_every(7), F.col("bmt_singletemp")).otherwise(F.col("cell_min_tem").cast("string"))
    text = T.StringType()
    return rows.select(
        "event_id", scalar_or_list(volt, text, largest=True).alias("pack_max_volt"),
        scalar_or_list(temp, text, largest=False).alias("pack_min_tem"),
        scalar_or_list(F.col("cell_max_volt"), T.DoubleType(), largest=True).alias("plain_max_volt"))


def _arrays(spark, sf) -> DataFrame:
    """Parsed arrays of the rows that have both, and the repaired voltages."""
    parsed = with_lists(derived_telemetry(spark, sf), {"cells": "bmv_singlevolt", "temps": "bmt_singletemp"})
    return parsed.where((F.size("cells") > 0) & (F.size("temps") > 0)).withColumn(
        "volts", C.repair_low(F.col("cells")))


def clean_cells(spark, sf):
    return _arrays(spark, sf).select("event_id", F.size("volts").alias("n_cells"), _joined("volts", 4).alias("cells"))


def arg_extremes(spark, sf):
    low, high = F.array_min("volts"), highest(F.col("temps"))
    return _arrays(spark, sf).select(
        "event_id", low.alias("low_volt"), C.index_of(F.col("volts"), low).alias("low_index"),
        high.alias("high_temp"), C.index_of(F.col("temps"), high).alias("high_index"))


def leave_one_out_mean(spark, sf):
    return _arrays(spark, sf).select(
        "event_id", r6(C.mean_without(F.col("volts"), F.array_min("volts"))).alias("rest_volt"),
        r6(C.mean_without(F.col("temps"), highest(F.col("temps")))).alias("rest_temp"))


def pack_features(spark, sf):
    rows = S1.pack_extremes(S1.drop_incomplete(S1.cast_pack_columns(derived_telemetry(spark, sf))))
    columns = S1.pack_features()
    return rows.select("event_id", *[(c if n == "temp_id" else r6(c)).alias(n) for n, c in columns.items()])


def parse_time(spark, sf):
    stamp = F.col("reltime")
    text = (F.when(_every(11), "2024-01-05").when(_every(13), F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit("+01:00")))
            .when(_every(17), "soon").when(_every(2), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
            .when(_every(3), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS"))
            .otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return derived_telemetry(spark, sf).select("event_id", epoch_of_text(text).alias("epoch"))


def parse_time_list(spark, sf):
    one = F.date_format("reltime", "yyyy-MM-dd HH:mm:ss")
    text = (F.when(_every(5), F.concat(one, F.lit(","), one, F.lit(".5")))
            .when(_every(7), F.concat(F.lit(","), one, F.lit(",")))
            .when(_every(11), F.concat(one, F.lit(",later"))).otherwise(one))
    times = derived_telemetry(spark, sf).select("event_id", epoch_list(text).alias("times"))
    return times.select("event_id", F.coalesce(F.size("times"), F.lit(-1)).alias("n_times"), _joined("times", 0).alias("epochs"))


# --- features and lookups ----------------------------------------------------

def _features(spark, sf, grids=None) -> DataFrame:
    feats = S1.features(derived_telemetry(spark, sf), TIE)
    return S1.with_soc(feats, grids) if grids is not None else feats


FEATURE_COLUMNS = ("volt_min", "volt_avg", "temp_max", "temp_avg", "temp_ambient", "current", "delta_v", "delta_t")


def features(spark, sf):
    return r6_all(_features(spark, sf), *FEATURE_COLUMNS).select(
        "event_id", KEY, "epoch", "pack_only", "temp_id", *FEATURE_COLUMNS)


def crate_sign(spark, sf):
    rate, sign = S1.rate_and_sign(F.col("current"), Config().cell.capacity)
    return _features(spark, sf).select("event_id", r6(rate).alias("crate"), sign.alias("direction"))


def interp_1d_query(spark, sf):
    grids = sample_grids()
    x = F.lit(2.8) + (F.col("event_id") % 170) / 100
    return derived_telemetry(spark, sf).select(
        "event_id", r6(interp_1d(x, grids.ocv, grids.soc)).alias("y"))


def interp_2d_query(spark, sf):
    grids = sample_grids()
    rows = with_location(derived_telemetry(spark, sf), "x", F.col("bcs_currentmeasure") + 20, grids.temp)
    rows = with_location(rows, "y", (F.col("event_id") % 23) / 20 - 0.05, grids.soc)
    rows = rows.withColumn("node", lower_node("x", "y", grids.soc))
    return rows.select("event_id", F.round(lookup([grids.tables["TSOC2R0_C"]], "node", "x", "y"), 9).alias("r0"),
                       r6(lookup([grids.tables["TSOC2OCV"]], "node", "x", "y")).alias("ocv"))


def soc_ocv(spark, sf):
    return _features(spark, sf, sample_grids()).select("event_id", r6("soc_avg").alias("soc_avg"),
                                                            r6("soc_min").alias("soc_min"))


def lookup_params(spark, sf):
    grids = sample_grids()
    digits = {"r0": 12, "r1": 12, "tao": 6, "ocv": 6, "dvds": 6}
    rows = S1.with_cell_model(_features(spark, sf, grids), grids, Config())
    return rows.select("event_id", *[F.round(c, n).alias(c) for c, n in digits.items()])


# --- windows and aggregates --------------------------------------------------

def _line(spark, sf, rows: DataFrame) -> Timeline:
    return Timeline(rows, KEY, ORDER, order_sizes(spark, sf))


def order_row_number(spark, sf):
    rows = derived_telemetry(spark, sf).select("event_id", KEY, "reltime")
    return windows.row_numbers(_line(spark, sf, rows)).select("event_id", KEY, "row_number")


def gap_seconds(spark, sf):
    rows = _features(spark, sf).select("event_id", KEY, "reltime", "epoch")
    return windows.gaps(_line(spark, sf, rows)).select("event_id", "soc_gap", "heat_gap")


def run_length(spark, sf):
    rows = _features(spark, sf).select("event_id", KEY, "reltime", "temp_max")
    return windows.run_lengths(_line(spark, sf, rows), "temp_max").select("event_id", "counter", "counter_delay")


def _fault_rows(spark, sf, config: Config = Config(), **options) -> DataFrame:
    return safety.safety_rows(derived_telemetry(spark, sf), sample_grids(), config, TIE,
                              sizes=order_sizes(spark, sf), **options)


def running_faults(spark, sf):
    return _fault_rows(spark, sf).select("event_id", "isc_total", "cap_total", "heat_total")


def fault_ret(spark, sf):
    return _fault_rows(spark, sf).select("event_id", "isc_ret", "cap_ret", "heat_ret")


def last_fault_dt(spark, sf):
    return _fault_rows(spark, sf).select("event_id", "event_dt")


def distinct_orders(spark, sf):
    return derived_telemetry(spark, sf).select(KEY).distinct()


def fault_rate(spark, sf):
    rates = windows.fault_rates(_fault_rows(spark, sf), order_sizes(spark, sf), KEY)
    return r6_all(rates, "isc_rate", "cap_rate", "heat_rate")


def running_fault_rate(spark, sf):
    rates = windows.running_fault_rates(_fault_rows(spark, sf), order_sizes(spark, sf), KEY)
    return rates.select("event_id", *[F.round(f"{f}_rate", 9).alias(f"{f}_rate") for f in windows.FAULTS])


# --- keyed folds -------------------------------------------------------------

def _fold(spark, sf, rows: DataFrame, scans, inputs, outputs) -> DataFrame:
    program = Program((Level(None, tuple(scans)),), tuple(inputs), outputs)
    return keyed_fold(rows, program, KEY, ORDER, ["event_id"], sizes=order_sizes(spark, sf))


def _values(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.col("user_id").cast("string").alias(KEY), F.col("ts").alias("reltime"), "value")


def ewma(spark, sf):
    out = _fold(spark, sf, _values(spark, sf), [Decay("smooth", "value", VALUE_DECAY)], ["value"],
                {"smooth": T.DoubleType()})
    # Two-decimal inputs make exact ties at the seventh decimal; this rounds them alike in any engine.
    return out.select("event_id", (F.floor(F.col("smooth") * 1e6 + 0.5) / 1e6).alias("smooth"))


def ewma_delta(spark, sf):
    feats = _features(spark, sf, sample_grids()).withColumn("soc_gap", F.col("soc_avg") - F.col("soc_min"))
    out = _fold(spark, sf, feats, [Decay("delta_soc", "soc_gap", SOC_DECAY), Decay("drift", "delta_v", VOLT_DECAY)],
                ["soc_gap", "delta_v"], {"delta_soc": T.DoubleType(), "drift": T.DoubleType()})
    return out.select("event_id", r6("delta_soc").alias("delta_soc"), r6("drift").alias("drift"))


def temp_hold(spark, sf):
    out = _fold(spark, sf, _features(spark, sf), [SpikeHold("held", "temp_max")], ["temp_max"],
                {"held": T.DoubleType()})
    return out.select("event_id", "held")


def heat_power(spark, sf):
    config = Config()
    program = Program(
        levels=safety.heat_levels(config), finish=safety.heat_power(config),
        inputs=("epoch", "temp_max", "temp_avg", "temp_ambient"),
        outputs={n: T.DoubleType() for n in ("p_max", "p_avg", "delta_p")})
    out = keyed_fold(_features(spark, sf), program, KEY, ORDER, ["event_id"], sizes=order_sizes(spark, sf))
    return r6_all(out, "p_max", "p_avg", "delta_p").select("event_id", "p_max", "p_avg", "delta_p")


def soc_ekf(spark, sf):
    scans = safety.soc_scans(Config(), sample_grids())
    outputs = {n: T.DoubleType() for s in scans for n in s.outputs}
    out = _fold(spark, sf, _features(spark, sf), scans,
                ["temp_avg", "temp_max", "volt_avg", "volt_min", "current", "epoch"], outputs)
    return r6_all(out, *outputs).select("event_id", *outputs)


def alarm_four_level(spark, sf):
    out = _fold(spark, sf, _values(spark, sf), [Alarm("level", "value", VALUE_ALARM, with_state=True)], ["value"],
                {"level": T.IntegerType(), "level_state": T.StringType()})
    return out.select("event_id", "level", "level_state")


def alarm_two_level(spark, sf):
    config = Config()
    out = _fold(spark, sf, _features(spark, sf),
                [Alarm("wv", "delta_v", config.wv, with_state=True), Alarm("wt", "delta_t", config.wt, with_state=True)],
                ["delta_v", "delta_t"],
                {"wv": T.IntegerType(), "wv_state": T.StringType(), "wt": T.IntegerType(), "wt_state": T.StringType()})
    return out.select("event_id", "wv", "wv_state", "wt", "wt_state")


def fault_flags(spark, sf):
    return _fault_rows(spark, sf).select("event_id", "wsoc", "wtt", "wv", "wt", "isc", "cap", "heat")


def _round_events(events: DataFrame) -> DataFrame:
    return r6_all(events, "MinVoltage", "MaxTemp", "DeltaP")


def _events(spark, sf, **options) -> DataFrame:
    rows = _fault_rows(spark, sf, **options)
    return _round_events(safety.event_columns(rows, ("event_id", F.col("wp").alias("wp_level"))))


def event_output(spark, sf):
    return _events(spark, sf)


def event_output_cut(spark, sf):
    """The same events with nearly every order cut into segments."""
    return _events(spark, sf, limit=40)


def event_output_ekf(spark, sf):
    """Events with the filtered state of charge."""
    return _events(spark, sf, config=Config(soc_method="ekf"))


#: The heat power alarm on the scale of the derived data, the drift alarm on the temperature gap.
DRIFT_CONFIG = Config(
    wtt_input="delta_t",
    wp=FourLevel(rise=(5.0, 10.0, 20.0, 40.0), settle=(4.0, 8.0, 16.0, 32.0), clear=(3.0, 6.0, 12.0, 24.0)))


def event_output_drift(spark, sf):
    """Events and all alarm levels with the drift alarm on the temperature gap."""
    rows = _fault_rows(spark, sf, DRIFT_CONFIG)
    return rows.select("event_id", "wp", "wsoc", "wtt", "wv", "wt", "isc", "cap", "heat", "isc_ret", "cap_ret", "heat_ret", "event_dt")


def _with_broken_rows(telemetry: DataFrame) -> DataFrame:
    return telemetry.withColumns({
        "bcs_currentmeasure": F.when(_every(487), F.lit("off")).otherwise(F.col("bcs_currentmeasure").cast("string")),
        "cell_max_volt": F.when(~_every(491), F.col("cell_max_volt")),
        KEY: F.when(~_every(503), F.col(KEY)),
        "reltime": F.when(_every(499), F.date_format("reltime", "yyyy-MM-dd"))
        .otherwise(F.date_format("reltime", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
    })


def failed_orders(spark, sf):
    return safety.failed_orders(S1.features(_with_broken_rows(derived_telemetry(spark, sf))))


def surviving_events(spark, sf):
    """Rows per order that are left once broken rows have taken their orders out."""
    rows = safety.safety_rows(_with_broken_rows(derived_telemetry(spark, sf)), sample_grids(), Config(), TIE,
                              sizes=order_sizes(spark, sf))
    return rows.groupBy(KEY).agg(F.count("*").alias("rows"), F.sum("cap").alias("cap_total"))


def resume_equals_full(spark, sf):
    """Events of two runs, the second one entered with the states the first one left."""
    telemetry, grids, sizes = derived_telemetry(spark, sf), sample_grids(), order_sizes(spark, sf)
    first = safety.safety_rows(telemetry.where(F.col("dt") < RESUME_AT), grids, tiebreak=TIE, with_state=True,
                               sizes=sizes)
    path = scratch_path(spark, "first-run")
    first.write.parquet(path)
    folded = spark.read.parquet(path)
    states = folded.where(F.col(STATE).isNotNull()).select(KEY, STATE)
    second = safety.safety_rows(telemetry.where(F.col("dt") >= RESUME_AT), grids, tiebreak=TIE, states=states,
                                sizes=sizes)
    both = folded.where(F.col(STATE).isNull()).drop(STATE).unionByName(second)
    return _round_events(safety.event_columns(both, ("event_id", F.col("wp").alias("wp_level"))))


def resume_after_failure(spark, sf):
    """Events of the last of three runs; in the second, some orders fail and keep the state of the first.

    The orders that fail have an unusable row between the two dates, so the third run goes on from the first.
    """
    telemetry, grids, sizes = derived_telemetry(spark, sf), sample_grids(), order_sizes(spark, sf)
    fails = F.col(KEY).cast("long") % 3 == 0
    parts = [
        telemetry.where(F.col("dt") < RESUME_AT),
        telemetry.where(F.col("dt").between(RESUME_AT, SECOND_END)).withColumn(
            "cell_max_volt", F.when(~fails, F.col("cell_max_volt"))),
        telemetry.where(F.col("dt") > SECOND_END)]
    states, rows = None, None
    for number, part in enumerate(parts):
        path = scratch_path(spark, f"run-{number}")
        safety.safety_rows(part, grids, tiebreak=TIE, states=states, with_state=True, sizes=sizes).write.parquet(path)
        folded = spark.read.parquet(path)
        states, rows = folded.where(F.col(STATE).isNotNull()).select(KEY, STATE), folded.where(F.col(STATE).isNull())
    return _round_events(safety.event_columns(rows, ("event_id", F.col("wp").alias("wp_level"))))


def stream_equals_batch(spark, sf):
    """Events of a stream in two triggers; the batch has to agree with them."""
    from ..streaming.stream import replay

    telemetry = derived_telemetry(spark, sf)
    parts = [telemetry.where(F.col("dt") < RESUME_AT), telemetry.where(F.col("dt") >= RESUME_AT)]
    events, _ = replay(spark, parts, sample_grids(), Config(), TIE, extra=(F.col("wp").alias("wp_level"),))
    return _round_events(events)


def stream_of_late_rows(spark, sf):
    """Events of a stream in which rows around the cut between its triggers have changed places."""
    from ..streaming.stream import replay

    telemetry = derived_telemetry(spark, sf)
    near = F.abs(F.unix_timestamp(F.col("reltime").cast("timestamp")) - F.unix_timestamp(F.lit(RESUME_AT), "yyyy-MM-dd")) < 43_200
    swapped = near & (F.col("event_id") % 3 == 0)
    first = (F.col("dt") < RESUME_AT) != swapped
    events, _ = replay(spark, [telemetry.where(first), telemetry.where(~first)], sample_grids(), Config(), TIE,
                       extra=(F.col("wp").alias("wp_level"),), lateness="25 hours")
    return _round_events(events)


def stream_from_batch(spark, sf):
    """Events of a batch run up to a date and of a stream that goes on from its states."""
    from ..streaming.stream import replay

    telemetry, grids = derived_telemetry(spark, sf), sample_grids()
    path = scratch_path(spark, "first-run")
    safety.safety_rows(telemetry.where(F.col("dt") < RESUME_AT), grids, tiebreak=TIE, with_state=True,
                       sizes=order_sizes(spark, sf)).write.parquet(path)
    folded, level = spark.read.parquet(path), F.col("wp").alias("wp_level")
    events, _ = replay(spark, [telemetry.where(F.col("dt") >= RESUME_AT)], grids, Config(), TIE, extra=(level,),
                       states=folded.where(F.col(STATE).isNotNull()).select(KEY, STATE))
    first = safety.event_columns(folded.where(F.col(STATE).isNull()), ("event_id", level))
    return _round_events(first.unionByName(events))


QUERIES: dict[str, Query] = {
    "scan_date_range": scan_date_range,
    "grid_load": grid_load,
    "sink_roundtrip": sink_roundtrip,
    "cast_double": cast_double,
    "null_skip": null_skip,
    "parse_cells": parse_cells,
    "scalar_or_list": scalar_or_list_query,
    "clean_cells": clean_cells,
    "arg_extremes": arg_extremes,
    "leave_one_out_mean": leave_one_out_mean,
    "pack_features": pack_features,
    "parse_time": parse_time,
    "parse_time_list": parse_time_list,
    "features": features,
    "crate_sign": crate_sign,
    "interp_1d": interp_1d_query,
    "interp_2d": interp_2d_query,
    "soc_ocv": soc_ocv,
    "lookup_params": lookup_params,
    "order_row_number": order_row_number,
    "gap_seconds": gap_seconds,
    "run_length": run_length,
    "running_faults": running_faults,
    "fault_ret": fault_ret,
    "last_fault_dt": last_fault_dt,
    "distinct_orders": distinct_orders,
    "fault_rate": fault_rate,
    "running_fault_rate": running_fault_rate,
    "ewma": ewma,
    "ewma_delta": ewma_delta,
    "temp_hold": temp_hold,
    "heat_power": heat_power,
    "soc_ekf": soc_ekf,
    "alarm_four_level": alarm_four_level,
    "alarm_two_level": alarm_two_level,
    "fault_flags": fault_flags,
    "event_output": event_output,
    "event_output_cut": event_output_cut,
    "event_output_ekf": event_output_ekf,
    "event_output_drift": event_output_drift,
    "failed_orders": failed_orders,
    "surviving_events": surviving_events,
    "resume_equals_full": resume_equals_full,
    "resume_after_failure": resume_after_failure,
    "stream_equals_batch": stream_equals_batch,
    "stream_of_late_rows": stream_of_late_rows,
    "stream_from_batch": stream_from_batch,
}
