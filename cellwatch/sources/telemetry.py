"""Telemetry tables: the expected columns, range scans, and the derived test view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TELEMETRY_COLUMNS = (
    "orderid", "batteryid", "reltime", "dt",
    "cell_max_volt", "cell_min_volt", "bmv_singlevolt",
    "cell_max_tem", "cell_min_tem", "bmt_singletemp", "bcs_currentmeasure",
)


#: Of a vector's values, so many are cell voltages and the rest temperatures.
CELLS, PROBES = 48, 16


def between_dates(telemetry: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the inclusive date range.

    ``dt`` stays a bare column compared with string literals, so the predicate
    prunes partitions or reaches the file scan.
    """
    return telemetry.where(F.col("dt").between(start, end))


def read_telemetry(spark: SparkSession, source: str, start: str, end: str) -> DataFrame:
    """Date range of a catalog table or of a parquet path, with every telemetry column."""
    table = spark.read.parquet(source) if "/" in source else spark.read.table(source)
    missing = [c for c in TELEMETRY_COLUMNS if c not in table.columns]
    if missing:
        raise ValueError(f"{source} lacks the telemetry columns {missing}")
    if table.schema["dt"].dataType != T.StringType():
        # Folder names that look like dates are read as such; the cast still prunes.
        table = table.withColumn("dt", F.col("dt").cast("string"))
    return between_dates(table, start, end)


def derived_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry derived from the ``events`` and ``embeddings`` tables.

    One row per event; ``event_id`` is kept as row identity and tiebreak.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    slots = vectors.agg(F.count("*")).scalar()
    e = F.col("event_id")

    def listed(first: int, count: int, base: float, spread: float, digits: int):
        text = F.transform(
            F.slice("embedding", first, count),
            lambda x: F.round(F.lit(base) + F.lit(spread) * x.cast("double"), digits).cast("string"),
        )
        return F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]"))

    # Many events share a vector, so the texts are made before the join.
    packs = vectors.select("vec_id", listed(1, CELLS, 3.45, 0.4, 4).alias("volts"),
                           listed(CELLS + 1, PROBES, 25.0, 40.0, 2).alias("temps"))
    volt = F.lit(3.45) - F.lit(0.1) * (e % 5) / 5
    temp = F.lit(30.0) + (e % 9)
    return (
        events.withColumn("vec_id", e % slots)
        .join(packs, "vec_id")
        .select(
            "event_id",
            F.col("user_id").cast("string").alias("orderid"),
            F.concat(F.lit("B"), (F.col("user_id") % 7).cast("string")).alias("batteryid"),
            F.col("ts").alias("reltime"),
            F.date_format("ts", "yyyy-MM-dd").alias("dt"),
            F.when(e % 97 != 0, F.round(volt, 4)).alias("cell_min_volt"),
            F.when(e % 101 != 0, temp).alias("cell_max_tem"),
            F.when(e % 11 == 0, "[]").otherwise(F.col("volts")).alias("bmv_singlevolt"),
            F.when(e % 13 != 0, F.col("temps")).alias("bmt_singletemp"),
            F.round(volt + F.lit(0.02) * (e % 8), 4).alias("cell_max_volt"),
            (temp - (e % 17)).alias("cell_min_tem"),
            F.round(F.col("value") - F.lit(50.0), 2).alias("bcs_currentmeasure"),
        )
    )


def order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ``orderid`` per telemetry row of the derived view, read from one column."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").cast("string").alias("orderid"))
