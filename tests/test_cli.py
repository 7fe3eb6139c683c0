from pyspark.sql import functions as F

from cellwatch.__main__ import main
from cellwatch.operators.features import KEY
from cellwatch.sources.grids import sample_grid_table, write_grids
from cellwatch.sources.sinks import read_events


def test_two_days_in_two_runs(spark, telemetry, tmp_path, capsys):
    raw, grids, events = (str(tmp_path / n) for n in ("raw", "grids", "events"))
    telemetry.withColumn("bcs_currentmeasure", F.when(F.col("event_id") == 40, "off").otherwise(
        F.col("bcs_currentmeasure").cast("string"))).write.partitionBy("dt").parquet(raw)
    write_grids(sample_grid_table(spark), grids)
    common = ["--source", raw, "--target", events, "--grids", grids, "--tiebreak", "event_id"]

    states, failed = str(tmp_path / "states"), str(tmp_path / "failed")
    code = main(["2024-01-01", "2024-01-03", *common, "--states-out", states, "--failed", failed], spark)
    assert code == 1 and "1 orders failed" in capsys.readouterr().out
    lost = telemetry.where("event_id = 40").first()[KEY]
    assert [r[KEY] for r in spark.read.parquet(failed).collect()] == [lost]
    assert read_events(spark, events).where(F.col(KEY) == lost).isEmpty()

    assert main(["2024-01-04", "2024-01-05", *common, "--states-in", states], spark) == 0
    assert "all orders processed" in capsys.readouterr().out
    days = {r.day for r in read_events(spark, events).select("day").distinct().collect()}
    assert days == {f"2024-01-0{d}" for d in range(1, 6)}


def test_nothing_to_do(spark, telemetry, tmp_path, capsys):
    raw = str(tmp_path / "raw")
    telemetry.write.parquet(raw)
    code = main(["2030-01-01", "2030-01-02", "--source", raw, "--target", str(tmp_path / "e"),
                 "--grids", str(tmp_path / "g")], spark)
    assert code == 0 and "no telemetry" in capsys.readouterr().out
