import math

import pytest
from pyspark.sql import functions as F, types as T

from cellwatch.functions import cells as C
from cellwatch.functions.parse import (
    epoch_list, epoch_seconds, parse_list, scalar_or_list, to_double, with_lists)


def evaluate(spark, schema, values, column):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {schema}")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


LISTS = [
    ("[3.1, 3.2]", [3.1, 3.2]),
    ("3.1,3.2", [3.1, 3.2]),
    ("[3.1, x]", None),
    ("[]", []),
    ("", []),
    ("[[1],2]", None),
    ("[[1,2]]", [1.0, 2.0]),
    (" [3.4]", None),
    ("[ 3.4 ,, 3.5 ]", [3.4, 3.5]),
    ("[\t3.4\n]", [3.4]),
    ("[1e2,-.5,+7.]", [100.0, -0.5, 7.0]),
    ("[3.4d]", None),
    ("[3f]", None),
    ("[0x1p3]", None),
    ("[inf, -Infinity]", [math.inf, -math.inf]),
    (None, None),
]


def test_text_lists(spark):
    got = evaluate(spark, "string", [text for text, _ in LISTS], lambda c: parse_list(c, T.StringType()))
    assert got == [want for _, want in LISTS]


def test_the_short_way_reads_the_same_lists(spark):
    texts = [text for text, _ in LISTS] + ["[", "]", "[3.4]", "[-1e300, 2]", "[nan, 3.5, inf]", "[3.4,]"]
    df = with_lists(spark.createDataFrame(list(enumerate(texts)), "i int, v string"), {"short": "v"})
    for r in df.withColumn("plain", parse_list(F.col("v"))).collect():
        assert repr(r.short) == repr(r.plain), r.v


def test_nan_items_are_numbers(spark):
    got, = evaluate(spark, "string", ["[nan, 3.5]"], parse_list)
    assert math.isnan(got[0]) and got[1] == 3.5


def test_array_lists(spark):
    got = evaluate(spark, "array<string>", [["1", "2.5"], ["1", "x"], [], None],
                   lambda c: parse_list(c, T.ArrayType(T.StringType())))
    assert got == [[1.0, 2.5], None, [], None]


def test_numbers(spark):
    got = evaluate(spark, "string", ["3.5", " 4 ", "x", "", "[3.5]", "5d", None], to_double)
    assert got == [3.5, 4.0, None, None, None, None, None]


NAN = float("nan")


@pytest.mark.parametrize("text, highest, lowest", [
    ("[1, 3, 2]", 3.0, 1.0),
    ("[3]", 3.0, 3.0),
    ("[]", None, None),
    ("[nan, 1]", NAN, NAN),
    ("[1, nan, 4]", 4.0, 1.0),
    ("[2, nan]", 2.0, 2.0),
])
def test_scalar_or_list_of_a_list(spark, text, highest, lowest):
    for largest, want in ((True, highest), (False, lowest)):
        got, = evaluate(spark, "string", [text], lambda c: scalar_or_list(c, T.StringType(), largest))
        assert got == want or (got is not None and math.isnan(got) and math.isnan(want))


def test_scalar_or_list_plain(spark):
    assert evaluate(spark, "double", [2.5, None], lambda c: scalar_or_list(c, T.DoubleType(), True)) == [2.5, None]
    assert evaluate(spark, "string", ["2.5", "x"], lambda c: scalar_or_list(c, T.StringType(), True)) == [2.5, None]


TIMES = [
    ("2024-01-05 10:11:12", 1704449472),
    ("2024-01-05 10:11:12.9", 1704449472),
    ("2024-01-05 10:11:12.123", 1704449472),
    ("2024-01-05 10:11:12.123456", 1704449472),
    ("2024-1-5 10:11:12", 1704449472),
    ("2024-01-05", None),
    ("2024-01-05T10:11:12", None),
    ("2024-01-05 10:11:12+01:00", None),
    ("2024-13-05 10:11:12", None),
    ("2024-01-05 10:11:12.1234567", None),
    ("soon", None),
    (None, None),
]


def test_times(spark):
    got = evaluate(spark, "string", [text for text, _ in TIMES], lambda c: epoch_seconds(c, T.StringType()))
    assert got == [want for _, want in TIMES]


def test_time_lists(spark):
    texts = [",2024-01-05 10:11:12,", "2024-01-05 10:11:12,2024-01-05 10:11:13.5", "2024-01-05 10:11:12,x"]
    assert evaluate(spark, "string", texts, epoch_list) == [[1704449472], [1704449472, 1704449473], None]
    # A list of one passes where lists are accepted, any other does not.
    got = evaluate(spark, "string", texts, lambda c: epoch_seconds(c, T.StringType(), listed=F.lit(True)))
    assert got == [1704449472, None, None]
    got = evaluate(spark, "string", texts[:1], lambda c: epoch_seconds(c, T.StringType(), listed=F.lit(False)))
    assert got == [None]


def test_timestamps_drop_the_fraction(spark):
    df = spark.sql("select timestamp_ntz'2024-01-05 10:11:12.9' v")
    assert df.select(epoch_seconds(F.col("v"), df.schema["v"].dataType)).first()[0] == 1704449472


REPAIRS = [
    ([3.4, 3.35, 3.6], [3.4, 3.6, 3.6]),
    ([3.0, 3.1], [3.1, 3.1]),
    ([3.4, float("nan"), 3.5], [3.4, 3.5, 3.5]),
    ([3.5], [3.5]),
]


def test_low_cells_are_replaced(spark):
    got = evaluate(spark, "array<double>", [v for v, _ in REPAIRS], C.repair_low)
    assert got == [want for _, want in REPAIRS]
    leading, = evaluate(spark, "array<double>", [[float("nan"), 3.5]], C.repair_low)
    assert math.isnan(leading[0]) and leading[1] == 3.5


def test_mean_without(spark):
    got = evaluate(spark, "array<double>", [[1.0, 2.0, 4.0], [5.0]], lambda c: C.mean_without(c, F.array_min(c)))
    assert got[0] == 3.0 and math.isnan(got[1])


def test_index_of(spark):
    assert evaluate(spark, "array<double>", [[2.0, 1.0, 1.0]], lambda c: C.index_of(c, F.array_min(c))) == [1]
