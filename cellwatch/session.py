"""Session helpers: where intermediate tables go and how large a task may get."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one order that a single task may process; longer orders are cut.
SPLIT_ROWS_SETTING = "cellwatch.split.rows"
DEFAULT_SPLIT_ROWS = 2_000_000


#: Session settings that suit this package.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    # Generated methods over 8000 bytes of bytecode are never compiled by the
    # JVM; beyond it the projection is better left out of whole-stage code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def split_rows(spark: SparkSession, override: int | None = None) -> int:
    if override is not None:
        return override
    return int(spark.conf.get(SPLIT_ROWS_SETTING, str(DEFAULT_SPLIT_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    This is the session's ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder of the machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None and sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cellwatch-"))
        current = sc.getCheckpointDir()
    return configured or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
