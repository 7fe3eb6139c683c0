"""Runs after other runs: states of failed orders, days that lose their events, rows without an order."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellwatch.config import Config
from cellwatch.operators.features import KEY, features, with_soc
from cellwatch.operators.fold import STATE
from cellwatch.plans import safety
from cellwatch.plans.safety import run_batch
from cellwatch.session import settle
from cellwatch.sources.grids import sample_grid_table, write_grids
from cellwatch.sources.sinks import DAY, read_events

TIE = ("event_id",)
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("limit", [10_000, 20])
def test_failed_orders_keep_the_state_they_came_with(telemetry, grids, limit):
    early = telemetry.where(F.col("dt") < "2024-01-12")
    late = telemetry.where(F.col("dt") >= "2024-01-12").withColumn(
        "cell_max_volt", F.when(F.col(KEY) != "6", F.col("cell_max_volt")))

    def run(rows, states):
        out = settle(safety.safety_rows(rows, grids, tiebreak=TIE, states=states, with_state=True, limit=limit))
        return out.where(F.col(STATE).isNull()), settle(out.where(F.col(STATE).isNotNull()).select(KEY, STATE))

    _, first = run(early, None)
    rows, second = run(late, first)
    before, after = ({r[KEY]: json.loads(r[STATE]) for r in s.collect()} for s in (first, second))
    assert set(after) == set(before) and after["6"] == before["6"]
    assert rows.where(F.col(KEY) == "6").isEmpty() and after["1"] != before["1"]


def test_days_without_events_go(spark, telemetry, grids, tmp_path):
    raw, broken, target = (str(tmp_path / n) for n in ("raw", "broken", "events"))
    telemetry.write.partitionBy("dt").parquet(raw)
    telemetry.withColumn("cell_max_volt", F.lit(None).cast("double")).write.partitionBy("dt").parquet(broken)
    run_batch(spark, raw, target, "2024-01-01", "2024-01-04", grids, tiebreak=TIE).close()
    again = run_batch(spark, broken, target, "2024-01-02", "2024-01-03", grids, tiebreak=TIE)
    assert {r[DAY] for r in read_events(spark, target, again.events.schema).select(DAY).distinct().collect()} == {
        "2024-01-01", "2024-01-04"}
    again.close()
    assert not Path(again.work.removeprefix("file:")).exists()


def test_a_day_is_few_files(spark, telemetry, grids, tmp_path):
    raw, target = str(tmp_path / "raw"), tmp_path / "events"
    telemetry.repartition(16).write.parquet(raw)
    run_batch(spark, raw, str(target), "2024-01-01", "2024-01-31", grids, tiebreak=TIE).close()
    assert all(len(list(day.glob("part-*"))) == 1 for day in target.glob(f"{DAY}=*"))


@pytest.mark.parametrize("limit", [10_000, 20])
def test_rows_without_an_order_fail_alone(telemetry, grids, limit):
    lost = telemetry.withColumn(KEY, F.when(F.col("event_id") % 4 != 0, F.col(KEY)))
    feats = settle(with_soc(features(lost, TIE), grids))
    rows = safety.fold_features(feats, grids, tiebreak=TIE, limit=limit)
    assert rows.where(F.col(KEY).isNull()).isEmpty()
    assert rows.count() == feats.where(F.col(KEY).isNotNull()).count()
    assert [(r[KEY], r["error"]) for r in safety.failed_orders(feats).collect()] == [(None, "orderid missing")]


def test_parameters_come_as_json():
    config = Config.of({"wtt_input": "delta_t", "wp": {"rise": [1.0, 2.0, 3.0, 4.0]}, "cell": {"mass": 1.5}, "debounced": True})
    assert config.wtt_input == "delta_t" and config.wp.rise == (1.0, 2.0, 3.0, 4.0) and config.wp.debounce_rows == 5
    assert config.cell.mass == 1.5 and config.cell.capacity == Config().cell.capacity
    with pytest.raises(ValueError, match="no parameter"):
        Config.of({"wpp": 1})


def test_launcher_runs_the_job(spark, telemetry, tmp_path):
    raw, grids, target = (str(tmp_path / n) for n in ("raw", "grids", "events"))
    telemetry.where(F.col("dt") < "2024-01-03").write.partitionBy("dt").parquet(raw)
    write_grids(sample_grid_table(spark), grids)
    done = subprocess.run(
        [sys.executable, str(ROOT / "cellwatch_job.py"), "2024-01-01", "2024-01-02", "--source", raw, "--target", target,
         "--grids", grids, "--tiebreak", "event_id", "--config", '{"soc_method": "ekf"}'],
        env={**__import__("os").environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false"
             f" --conf spark.checkpoint.dir={tmp_path}/checkpoints pyspark-shell", "PYTHONPATH": str(ROOT)},
        capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "all orders processed" in done.stdout, done.stderr[-2000:]
    assert read_events(spark, target).count() > 0
