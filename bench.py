"""Time the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (data folder), ``BENCH_CPUS`` (local cores), and
``BENCH_LOOP`` (a number of orders: also time a driver loop with one scan, one
sort and one append per order, for comparison).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from cellwatch.plans import catalog, safety
from cellwatch.session import RECOMMENDED
from cellwatch.sources.grids import sample_grids
from cellwatch.sources.telemetry import derived_telemetry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LOOP_ORDERS = int(os.environ.get("BENCH_LOOP", "0"))

HEADLINE = (
    "scan_date_range", "parse_cells", "features", "soc_ocv", "lookup_params", "order_row_number", "gap_seconds",
    "run_length", "distinct_orders", "ewma", "temp_hold", "heat_power", "soc_ekf", "alarm_four_level",
    "alarm_two_level", "fault_flags", "running_faults", "fault_rate", "event_output", "failed_orders",
)


def session(work: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("cellwatch-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{work}/checkpoints")
        .config(map=RECOMMENDED)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def per_order_loop(spark, raw: str, target: str, orders: int) -> dict:
    """A driver loop over orders: scan and sort one, run it here, append its events."""
    telemetry = spark.read.parquet(raw)
    grids, program = sample_grids(), safety.safety_program(catalog.Config(), sample_grids())
    keys = [r[0] for r in telemetry.select("orderid").distinct().orderBy("orderid").limit(orders).collect()]
    rows, started = 0, time.perf_counter()
    for key in keys:
        feats = safety.with_soc(safety.features(telemetry.where(F.col("orderid") == key), ("event_id",)), grids)
        order = feats.orderBy("reltime", "event_id").toPandas()
        states = program.initial()
        columns = {n: order[n].to_numpy() for n in program.inputs}
        for i in range(len(order)):
            program.run({n: c[i:i + 1] for n, c in columns.items()}, states)
        spark.createDataFrame(order[["orderid", "event_id"]]).write.mode("append").parquet(target)
        rows += len(order)
    took = time.perf_counter() - started
    return {"orders": len(keys), "rows": rows, "sec": round(took, 3), "rows_per_sec": round(rows / took, 1)}


def main() -> None:
    work = tempfile.mkdtemp(prefix="cellwatch-bench-")
    spark = session(work)
    drain(catalog.QUERIES["event_output"](spark, SF_DIR))  # warm-up
    seconds = {name: timed(lambda n=name: drain(catalog.QUERIES[n](spark, SF_DIR))) for name in HEADLINE}

    raw = f"{work}/telemetry"
    derived_telemetry(spark, SF_DIR).repartition(int(CPUS), "event_id").write.parquet(raw)
    rows = spark.read.parquet(raw).count()
    seconds["batch_job"] = timed(lambda: safety.run_batch(
        spark, raw, f"{work}/events", "2000-01-01", "2100-01-01", sample_grids(), tiebreak=("event_id",)))
    stored = spark.read.parquet(raw)
    seconds["events_of_stored_telemetry"] = timed(
        lambda: drain(safety.fault_events(stored, sample_grids(), tiebreak=("event_id",))))
    result = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(re.search(r"sf([0-9.]+)", SF_DIR).group(1)) if "sf" in SF_DIR else None,
        "rows": rows, "rows_per_sec_batch_job": round(rows / seconds["batch_job"], 1),
        "rows_per_sec_events": round(rows / seconds["events_of_stored_telemetry"], 1),
    }
    if LOOP_ORDERS:
        result["per_order_loop"] = per_order_loop(spark, raw, f"{work}/loop", LOOP_ORDERS)
    spark.stop()
    print(json.dumps(result))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
