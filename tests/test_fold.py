"""Long orders cut into segments give what a single pass gives."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F, types as T

from cellwatch.config import Config
from cellwatch.operators import windows
from cellwatch.operators.features import KEY, features, with_soc
from cellwatch.operators.fold import Level, Program, STATE, keyed_fold
from cellwatch.operators.scans import Decay
from cellwatch.operators.segments import SEGMENT, split_long
from cellwatch.operators.timeline import Timeline
from cellwatch.plans import safety
from cellwatch.session import settle

ORDER = ["reltime", "event_id"]
TIE = ("event_id",)
WHOLE, CUT = 10_000, 60


@pytest.fixture(scope="module")
def skewed(spark, telemetry):
    """Telemetry in which one order holds a third of all rows."""
    return settle(telemetry.withColumn(
        KEY, F.when(F.col("event_id") % 3 == 0, "big").otherwise(F.col(KEY))))


@pytest.fixture(scope="module")
def feats(skewed, grids):
    return settle(with_soc(features(skewed, TIE), grids))


def frame(df, by=("event_id",)):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def assert_same(left, right):
    left, right = frame(left), frame(right)[frame(left).columns]
    assert len(left) == len(right)
    for c in left.columns:
        if left[c].dtype == float:
            assert ((left[c] == right[c]) | (left[c].isna() & right[c].isna())).all(), c
        else:
            assert (left[c] == right[c]).all(), c


def test_only_long_orders_are_cut(feats):
    split = split_long(feats, KEY, ORDER, limit=CUT)
    sizes = {r[KEY]: r["count"] for r in feats.groupBy(KEY).count().collect()}
    long_keys = {k for k, n in sizes.items() if n > CUT}
    assert {r[KEY] for r in split.keys.collect()} == long_keys and "big" in long_keys
    assert {r[KEY] for r in split.short.select(KEY).distinct().collect()} == set(sizes) - long_keys
    parts = split.long.groupBy(KEY, SEGMENT).agg(
        F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("lo"), F.max(F.struct(*ORDER)).alias("hi")).collect()
    big = sorted((p for p in parts if p[KEY] == "big"), key=lambda p: p[SEGMENT])
    assert len(big) > 2 and max(p.n for p in big) < sizes["big"] / 2
    for a, b in zip(big, big[1:]):
        assert tuple(a.hi) < tuple(b.lo)
    assert split.short.count() + split.long.count() == sum(sizes.values())
    assert split_long(feats, KEY, ORDER, limit=WHOLE).long is None


def test_cut_orders_equal_whole_orders(feats, grids):
    whole = safety.fold_features(feats, grids, tiebreak=TIE, limit=WHOLE)
    assert_same(whole, safety.fold_features(feats, grids, tiebreak=TIE, limit=CUT))


def test_cut_orders_equal_whole_orders_with_a_filter_that_has_no_summary(feats, grids):
    config = replace(Config().debounced(), soc_method="ekf", fix_pmax_time=True, wtt_input="delta_t")
    whole = safety.fold_features(feats, grids, config, TIE, limit=WHOLE)
    assert_same(whole, safety.fold_features(feats, grids, config, TIE, limit=300))


def test_cut_orders_hand_their_state_on(feats, grids):
    early = F.col("dt") < "2024-01-12"
    whole = safety.fold_features(feats, grids, tiebreak=TIE, limit=WHOLE)
    first = settle(safety.fold_features(feats.where(early), grids, tiebreak=TIE, with_state=True, limit=100))
    states = first.where(F.col(STATE).isNotNull()).select(KEY, STATE)
    keys = {r[KEY] for r in feats.where(early).select(KEY).distinct().collect()}
    assert sorted(r[KEY] for r in states.collect()) == sorted(keys)
    second = safety.fold_features(feats.where(~early), grids, tiebreak=TIE, states=states, limit=100)
    assert_same(whole, first.where(F.col(STATE).isNull()).drop(STATE).unionByName(second))


def test_orders_with_an_error_are_left_out_whole(feats, grids):
    broken = feats.withColumn("error", F.when(F.col("event_id").isin(500, 501, 999), "bad"))
    lost = [r[KEY] for r in broken.where("error is not null").select(KEY).distinct().collect()]
    assert "big" in lost and len(lost) > 1
    kept = safety.fold_features(feats.where(~F.col(KEY).isin(lost)), grids, tiebreak=TIE, limit=WHOLE)
    for limit in (WHOLE, 100):
        assert_same(kept, safety.fold_features(broken, grids, tiebreak=TIE, limit=limit))
    failed = {r[KEY]: r.error for r in safety.failed_orders(broken).collect()}
    assert failed == {k: "bad" for k in lost}


def test_row_and_key_names_do_not_matter(feats, grids):
    plain = safety.fold_features(feats, grids, tiebreak=TIE, limit=WHOLE)
    shuffled = feats.repartition(7, "event_id").withColumn(KEY, F.concat(F.lit("x"), F.reverse(KEY)))
    renamed = safety.fold_features(shuffled, grids, tiebreak=TIE, limit=WHOLE)
    assert_same(plain, renamed.withColumn(KEY, F.reverse(F.expr(f"substring({KEY}, 2)"))))


def test_empty_input_gives_an_empty_typed_result(feats, grids):
    full = safety.fold_features(feats, grids, tiebreak=TIE)
    empty = safety.fold_features(feats.where("false"), grids, tiebreak=TIE)
    assert empty.schema == full.schema and empty.count() == 0


def test_one_order_across_many_arrow_batches(spark, feats, grids):
    whole = frame(safety.fold_features(feats, grids, tiebreak=TIE, limit=WHOLE))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        tiny = frame(safety.fold_features(feats, grids, tiebreak=TIE, limit=WHOLE))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for c in whole.columns:
        assert (whole[c] == tiny[c]).all() or (whole[c] - tiny[c]).abs().max() < 1e-12, c


def test_short_orders_take_one_exchange_and_no_window(feats, grids):
    plan = safety.fold_features(feats, grids, tiebreak=TIE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


@pytest.mark.parametrize("column", [
    lambda line: windows.row_numbers(line),
    lambda line: windows.gaps(line),
    lambda line: windows.run_lengths(line, "temp_max"),
    lambda line: windows.fault_codes(windows.running_faults(line).table()),
    lambda line: windows.latest_fault_date(line),
], ids=["row_numbers", "gaps", "run_lengths", "fault_codes", "latest_fault_date"])
def test_cut_windows_equal_whole_windows(feats, column):
    rows = feats.select("event_id", KEY, "reltime", "dt", "epoch", "temp_max",
                        *[(F.col("event_id") % n == 0).cast("int").alias(f)
                          for f, n in (("isc", 83), ("cap", 41), ("heat", 57))])
    whole, cut = (column(Timeline(rows, KEY, ORDER, limit=limit)) for limit in (WHOLE, CUT))
    assert_same(whole, cut)


def test_rows_without_a_key_are_cut_as_one_order(feats):
    rows = feats.select("event_id", F.when(F.col(KEY) != "big", F.col(KEY)).alias(KEY), "reltime", "epoch", "temp_max")
    split = split_long(rows, KEY, ORDER, limit=CUT)
    without = F.col(KEY).isNull()
    assert split.short.where(without).count() == 0
    assert split.long.where(without).count() == rows.where(without).count() > CUT
    for column in (windows.row_numbers, windows.gaps, lambda line: windows.run_lengths(line, "temp_max")):
        assert_same(*(column(Timeline(rows, KEY, ORDER, limit=limit)).drop(KEY) for limit in (WHOLE, CUT)))


def test_windows_and_fold_agree(feats, grids):
    rows = settle(safety.fold_features(feats, grids, tiebreak=TIE))
    line = rows.select("event_id", KEY, "reltime", "dt", "isc", "cap", "heat")
    codes = windows.fault_codes(windows.running_faults(Timeline(line, KEY, ORDER)).table())
    names = ["event_id", "isc_ret", "cap_ret", "heat_ret"]
    assert_same(rows.select(names), codes.select(names))
    dates = windows.latest_fault_date(Timeline(line, KEY, ORDER))
    assert_same(rows.select("event_id", "event_dt"), dates.select("event_id", "event_dt"))


def test_null_numbers_become_nan_and_stay(spark):
    rows = spark.createDataFrame([("a", i, None if i == 2 else 1.0) for i in range(4)], "orderid string, i int, x double")
    program = Program((Level(None, (Decay("y", "x", 0.5),)),), ("x",), {"y": T.DoubleType()})
    got = [r.y for r in keyed_fold(rows, program, KEY, ["i"], ["i"]).orderBy("i").collect()]
    assert got[:2] == [0.5, 0.75] and got[2] != got[2] and got[3] != got[3]


def test_tasks_grow_with_rows_and_not_with_cuts(feats):
    split = split_long(feats, KEY, ORDER, limit=5)
    parts = split.long.groupBy(KEY, SEGMENT).count().collect()
    assert split.long.rdd.getNumPartitions() == 2 and len(parts) > 150
    assert max(p["count"] for p in parts) <= 5 and len(parts) <= split.bound


def test_segments_too_many_to_broadcast(feats, grids, monkeypatch):
    from cellwatch.operators import fold, segments

    early = F.col("dt") < "2024-01-12"
    whole = safety.fold_features(feats, grids, tiebreak=TIE, limit=WHOLE)
    monkeypatch.setattr(segments, "TASK_ROWS", 50)
    for module in (fold, segments):
        monkeypatch.setattr(module, "MOST_BROADCAST_ROWS", 0)
    first = settle(safety.fold_features(feats.where(early), grids, tiebreak=TIE, with_state=True, limit=7))
    states = first.where(F.col(STATE).isNotNull()).select(KEY, STATE)
    second = safety.fold_features(feats.where(~early), grids, tiebreak=TIE, states=states, limit=7)
    assert_same(whole, first.where(F.col(STATE).isNull()).drop(STATE).unionByName(second))
