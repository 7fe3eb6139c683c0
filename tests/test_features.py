import math

import pytest
from pyspark.sql import functions as F, types as T

from cellwatch.operators.features import features, with_soc

SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("orderid", T.StringType()),
    T.StructField("batteryid", T.StringType()), T.StructField("reltime", T.StringType()),
    T.StructField("dt", T.StringType()), T.StructField("cell_min_volt", T.StringType()),
    T.StructField("cell_max_tem", T.StringType()), T.StructField("bmv_singlevolt", T.StringType()),
    T.StructField("bmt_singletemp", T.StringType()), T.StructField("cell_max_volt", T.StringType()),
    T.StructField("cell_min_tem", T.StringType()), T.StructField("bcs_currentmeasure", T.StringType()),
])
GOOD = dict(orderid="a", batteryid="B1", reltime="2024-01-05 10:11:12", dt="2024-01-05", cell_min_volt="3.4",
            cell_max_tem="31", bmv_singlevolt="[3.4, 3.5, 3.6]", bmt_singletemp="[20, 30, 28]", cell_max_volt="3.6",
            cell_min_tem="20", bcs_currentmeasure="12.5")


def one(spark, **changes):
    rows = run(spark, [changes])
    return rows[0] if rows else None


def run(spark, changes):
    rows = [tuple({**GOOD, "event_id": i, **c}[f.name] for f in SCHEMA) for i, c in enumerate(changes)]
    return features(spark.createDataFrame(rows, SCHEMA), ("event_id",)).orderBy("event_id").collect()


def test_cell_path(spark):
    r = one(spark)
    assert r.error is None and not r.pack_only
    assert (r.volt_min, r.volt_avg) == (3.4, pytest.approx(3.55))
    assert (r.temp_max, r.temp_id, r.temp_avg, r.temp_ambient) == (30.0, 1, 24.0, 20.0)
    assert (r.current, r.epoch) == (-12.5, 1704449472)
    assert (r.delta_v, r.delta_t) == (pytest.approx(0.15), 6.0)


@pytest.mark.parametrize("column", ["bmv_singlevolt", "bmt_singletemp"])
@pytest.mark.parametrize("text", [None, "", "[]", "[3.1, x]", "[[1],2]"])
def test_missing_or_unreadable_lists_take_the_pack_path(spark, column, text):
    r = one(spark, **{column: text})
    assert r.error is None and r.pack_only
    assert (r.volt_min, r.volt_avg) == (pytest.approx(3.6 - 2 * (3.6 - 3.4)), 3.4)
    assert (r.temp_max, r.temp_avg, r.temp_ambient, r.temp_id) == (31.0, 25.5, 20.0, 1)


def test_pack_columns_may_be_lists(spark):
    r = one(spark, bmv_singlevolt=None, cell_max_volt="[3.5, 3.7]", cell_min_tem="[21, 19]")
    assert (r.volt_min, r.temp_ambient) == (pytest.approx(3.7 - 2 * (3.7 - 3.4)), 19.0)


@pytest.mark.parametrize("column", ["cell_min_volt", "cell_max_tem"])
@pytest.mark.parametrize("text", [None, "x", "[3.4]"])
def test_rows_without_required_numbers_are_skipped(spark, column, text):
    assert one(spark, **{column: text}) is None


def test_single_cells_have_no_average(spark):
    r = one(spark, bmv_singlevolt="[3.5]", bmt_singletemp="[25]")
    assert r.volt_min == 3.5 and math.isnan(r.volt_avg) and math.isnan(r.delta_v)
    assert r.temp_max == 25 and math.isnan(r.temp_avg)


def test_low_cells_are_repaired_first(spark):
    r = one(spark, bmv_singlevolt="[3.0, 3.2, 3.3]")
    assert (r.volt_min, r.volt_avg) == (3.3, pytest.approx(3.3))


def test_all_zero_arrays_fall_back_to_the_pack(spark):
    r = one(spark, bmv_singlevolt="[0, 0]", bmt_singletemp="[0, 0]")
    assert (r.volt_min, r.volt_avg) == (3.4, 3.5) and (r.temp_max, r.temp_avg) == (31.0, 25.5)


@pytest.mark.parametrize("change,reason", [
    (dict(bcs_currentmeasure="off"), "bcs_currentmeasure unreadable"),
    (dict(bcs_currentmeasure=None), "bcs_currentmeasure unreadable"),
    (dict(cell_max_volt=None), "cell_max_volt unreadable"),
    (dict(cell_max_volt="[]"), "cell_max_volt unreadable"),
    (dict(cell_min_tem="[1, x]"), "cell_min_tem unreadable"),
    (dict(reltime="2024-01-05"), "reltime unreadable"),
    (dict(reltime="2024-01-05 10:11:12,2024-01-05 10:11:13"), "reltime unreadable"),
    (dict(reltime="2024-01-05 10:11:12,2024-01-05 10:11:13", bmv_singlevolt=None), "reltime unreadable"),
])
def test_errors(spark, change, reason):
    assert one(spark, **change).error == reason


def test_a_comma_around_one_time_passes_only_on_the_pack_path(spark):
    assert one(spark, reltime="2024-01-05 10:11:12,", bmv_singlevolt=None).epoch == 1704449472
    assert one(spark, reltime="2024-01-05 10:11:12,").error == "reltime unreadable"


def test_native_types(spark):
    df = spark.createDataFrame([(
        0, "a", "B", "2024-01-05", 3.4, 31.0, [3.4, 3.5], [20.0, 30.0], 3.6, 20.0, 7)],
        "event_id long, orderid string, batteryid string, dt string, cell_min_volt double, cell_max_tem double, "
        "bmv_singlevolt array<double>, bmt_singletemp array<double>, cell_max_volt double, cell_min_tem double, "
        "bcs_currentmeasure int").withColumn("reltime", F.expr("timestamp'2024-01-05 10:11:12'"))
    r = features(df).first()
    assert r.error is None and (r.volt_min, r.temp_max, r.current, r.epoch) == (3.4, 30.0, -7.0, 1704449472)
    broken = features(df.withColumn("bmv_singlevolt", F.array(F.lit(None).cast("double"), F.lit(3.5)))).first()
    assert broken.error == "cell array unreadable"


def test_soc_is_clamped_to_the_curve(spark, grids):
    df = spark.createDataFrame([(2.0, 5.0), (3.45, float("nan"))], "volt_avg double, volt_min double")
    low, mid = with_soc(df, grids).collect()
    assert (low.soc_avg, low.soc_min) == (0.0, 1.0)
    assert mid.soc_avg == pytest.approx(0.525) and math.isnan(mid.soc_min)


def test_parsing_reads_only_needed_columns(telemetry):
    plan = features(telemetry.select("*", F.lit(1).alias("unused"))).select("epoch")._jdf.queryExecution()
    assert "unused" not in plan.optimizedPlan().toString()
