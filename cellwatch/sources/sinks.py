"""Writing and reading the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Partition column: the date of the telemetry row itself.  An event's ``dt`` is
#: the date of the order's latest faulty row and may lie before the run's range,
#: where overwriting a partition would lose the events of an earlier run.
DAY = "day"


def is_path(target: str) -> bool:
    return "/" in target


def write_events(events: DataFrame, target: str, mode: str = "overwrite", span: tuple[str, str] | None = None) -> None:
    """Write events, partitioned by ``day``, to a parquet path or a catalog table.

    ``overwrite`` replaces the days that occur in ``events`` and, of the dates of
    ``span`` (both ends included), removes days that have no events any more, so
    running a range again leaves nothing of the run before; ``append`` adds rows.
    Rows are dealt out by day first, a large day to several tasks.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode!r}")
    _write(events.hint("rebalance", DAY), target, mode)
    if mode == "overwrite" and span is not None:
        # As many rows as the range has days.
        written = {str(r[0]) for r in events.select(DAY).distinct().collect()}
        _remove_days(events.sparkSession, target, span, written)


def _remove_days(spark: SparkSession, target: str, span: tuple[str, str], written: set[str]) -> None:
    """Drop the partitions of days within ``span`` that are not ``written``."""
    if not is_path(target):
        days = [r[0].partition("=")[2] for r in spark.sql(f"show partitions {target}").collect()]
        for day in days:
            if span[0] <= day <= span[1] and day not in written:
                spark.sql(f"alter table {target} drop if exists partition ({DAY} = '{day}')")
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(path) if store.exists(path) else []:
        name, _, day = status.getPath().getName().partition("=")
        if name == DAY and span[0] <= day <= span[1] and day not in written:
            store.delete(status.getPath(), True)


def _write(events: DataFrame, target: str, mode: str) -> None:
    spark = events.sparkSession
    if not is_path(target) and spark.catalog.tableExists(target):
        # insertInto goes by position, so take the table's own column order.
        ordered = events.select(*spark.table(target).columns)
        ordered.write.option("partitionOverwriteMode", "dynamic").insertInto(target, overwrite=mode == "overwrite")
        return
    writer = events.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY)
    if is_path(target):
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def read_events(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """The event table.

    A path that may hold no events yet needs the ``schema``.  ``day`` is text
    however the folder names were read.
    """
    if not is_path(target):
        return spark.read.table(target)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(target).withColumn(DAY, F.col(DAY).cast("string"))
