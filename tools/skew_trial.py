"""Time the fold on telemetry in which one order holds a third of all rows.

Usage: python tools/skew_trial.py [rows] [split limit ...]

Prints per limit the time of the fold and sums over its results, which must
not depend on the limit.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from cellwatch.operators.features import features, with_soc  # noqa: E402
from cellwatch.plans import safety  # noqa: E402
from cellwatch.session import RECOMMENDED  # noqa: E402
from cellwatch.sources.grids import sample_grids  # noqa: E402


def skewed_telemetry(spark: SparkSession, rows: int):
    """A third of the rows in one order, the rest in orders of about a thousand rows."""
    i = F.col("id")

    def noise(seed: int):
        return (F.abs(F.hash(i, F.lit(seed))) % 1000) / 1000

    def listed(n: int, base: float, spread: float):
        parts = [F.format_number(F.lit(base) + F.lit(spread) * noise(k), 3) for k in range(n)]
        return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))

    return spark.range(rows).select(
        i.alias("event_id"),
        F.when(i % 3 == 0, "hot").otherwise((i % (rows // 1000)).cast("string")).alias("orderid"),
        F.lit("B").alias("batteryid"),
        F.timestamp_seconds(i + 1_700_000_000).alias("reltime"),
        F.date_format(F.timestamp_seconds(i + 1_700_000_000), "yyyy-MM-dd").alias("dt"),
        F.lit(3.45).alias("cell_min_volt"), F.lit(30.0).alias("cell_max_tem"),
        listed(8, 3.4, 0.2).alias("bmv_singlevolt"), listed(4, 25.0, 12.0).alias("bmt_singletemp"),
        F.lit(3.5).alias("cell_max_volt"), F.lit(20.0).alias("cell_min_tem"),
        (noise(99) * 100 - 50).alias("bcs_currentmeasure"),
    )


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    limits = [int(x) for x in sys.argv[2:]] or [10 * rows, rows // 30]
    work = tempfile.mkdtemp(prefix="cellwatch-skew-")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "10g")
        .config(map=RECOMMENDED)
        .config("spark.checkpoint.dir", f"{work}/checkpoints").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    grids = sample_grids()
    started = time.time()
    skewed_telemetry(spark, rows).write.parquet(f"{work}/raw")
    print(f"generated {rows} rows in {time.time() - started:.1f}s", flush=True)
    started = time.time()
    with_soc(features(spark.read.parquet(f"{work}/raw"), ("event_id",)), grids).write.parquet(f"{work}/features")
    print(f"features in {time.time() - started:.1f}s", flush=True)
    feats = spark.read.parquet(f"{work}/features")
    for limit in limits:
        started = time.time()
        out = safety.fold_features(feats, grids, tiebreak=("event_id",), limit=limit, sizes=feats.select("orderid"))
        sums = out.agg(F.count("*"), F.sum("wsoc"), F.sum("wv"), F.sum("wt"), F.sum("cap"), F.sum("isc_ret"),
                       F.round(F.sum("delta_p"), 4), F.sum(F.crc32("event_dt"))).first()
        print(f"limit {limit}: {time.time() - started:.1f}s {tuple(sums)}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
