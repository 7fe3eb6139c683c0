import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwatch.config import Cell, Config
from cellwatch.functions.interp import interp_1d, lookup, lower_node, with_location
from cellwatch.operators.ekf import KalmanSoc
from cellwatch.operators.features import with_cell_model
from cellwatch.sources.grids import load_grids, read_grids, sample_grid_table, write_grids


def test_one_dimension_extends_outwards(spark):
    xs, ys = [1.0, 2.0, 4.0], [10.0, 20.0, 0.0]
    points = [0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(interp_1d(F.col("x"), xs, ys)).collect()]
    assert got == [0.0, 10.0, 15.0, 20.0, 10.0, 0.0, -10.0]
    nan = df.limit(1).select(interp_1d(F.lit(float("nan")), xs, ys)).first()[0]
    assert math.isnan(nan)


def test_two_dimensions_match_numpy(spark):
    rng = np.random.default_rng(5)
    xs, ys = [0.0, 1.0, 3.0], [0.0, 2.0, 5.0, 6.0]
    grid = rng.normal(size=(3, 4))
    points = [(float(x), float(y)) for x in (-1, 0, .4, 1, 2.9, 3, 9) for y in (-1, 0, 1, 2, 5.5, 6, 8)]
    df = spark.createDataFrame(points, "x double, y double")
    df = with_location(with_location(df, "a", F.col("x"), xs), "b", F.col("y"), ys)
    df = df.withColumn("n", lower_node("a", "b", ys))
    for r in df.withColumn("z", lookup([grid], "n", "a", "b")).collect():
        along = [np.interp(r.y, ys, row) for row in grid]
        assert r.z == pytest.approx(np.interp(r.x, xs, along), abs=1e-12)


def test_grids_survive_storage_and_tau_is_mirrored(spark, grids, tmp_path):
    table = sample_grid_table(spark)
    write_grids(table, str(tmp_path / "grids"))
    stored = read_grids(spark, str(tmp_path / "grids"))
    assert stored.breaks == grids.breaks
    for name, values in grids.tables.items():
        assert np.array_equal(values, stored.tables[name])
    assert list(grids.tables["TSOC2tao_C"][0]) == [60.0, 58.0, 56.0, 26.0, 22.0, 20.0]


def test_incomplete_grid_tables_are_refused(spark):
    table = sample_grid_table(spark)
    with pytest.raises(ValueError, match="lacks"):
        load_grids(table.where("grid <> 'TSOC2OCV'"))
    with pytest.raises(ValueError, match="holes"):
        load_grids(table.where("not (grid = 'TSOC2OCV' and ix = 1 and iy = 1)"))


def test_column_model_matches_the_filters_model(spark, grids):
    rows = [(t, i, s) for t in (-30.0, 10.0, 70.0) for i in (-80.0, 0.0, 700.0) for s in (0.0, 0.33, 1.0)]
    df = with_cell_model(spark.createDataFrame(rows, "temp_avg double, current double, soc_avg double"), grids, Config())
    scan = KalmanSoc("k", "t", "v", "i", "e", grids, Cell())
    for r in df.collect():
        profiles = scan._profiles(np.array([r.temp_avg]), np.array([r.current]))
        got = [np.interp(r.soc_avg, grids.soc, p[0]) for p in profiles]
        assert got == pytest.approx([r.r0, r.r1, r.tao, r.ocv, r.dvds], abs=1e-12)


def test_sample_grids_tell_directions_and_neighbours_apart(grids):
    """Otherwise a lookup in a wrong table or cell could give a right value."""
    for name, table in grids.tables.items():
        if name.endswith("_C"):
            assert not np.isclose(table, grids.tables[name[:-1] + "D"]).any(), name
        steps = np.diff(table, axis=1) / np.diff(grids.rate if name.startswith("TI") else grids.soc)
        assert not np.isclose(steps[:, 1:], steps[:, :-1], rtol=1e-6).all(), name
