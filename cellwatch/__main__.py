"""Command line of the daily batch: ``python -m cellwatch --help``; ``cellwatch_job.py`` is for ``spark-submit``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import Config
from .plans.safety import run_batch
from .session import RECOMMENDED
from .sources.grids import read_grids
from .sources.telemetry import read_telemetry


def arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cellwatch", description="Fault events of a range of telemetry dates.")
    parser.add_argument("start", help="first date, yyyy-MM-dd")
    parser.add_argument("end", help="last date, inclusive")
    parser.add_argument("--source", required=True, help="telemetry table or parquet path")
    parser.add_argument("--target", required=True, help="event table or parquet path")
    parser.add_argument("--grids", required=True, help="parquet path of the lookup grid table")
    parser.add_argument("--failed", help="parquet path for the orders that failed")
    parser.add_argument("--states-in", help="parquet path of the states an earlier run left")
    parser.add_argument("--states-out", help="parquet path for the states this run leaves")
    parser.add_argument("--tiebreak", nargs="*", default=[], help="columns that order rows of equal time")
    parser.add_argument("--mode", choices=("overwrite", "append"), default="overwrite")
    parser.add_argument("--soc-method", choices=("ocv", "ekf"), help="overrides the parameters' own")
    parser.add_argument("--config", help="JSON of parameters that differ from the defaults, or @ and the name of a local file")
    return parser.parse_args(argv)


def parameters(args: argparse.Namespace) -> Config:
    text = args.config or "{}"
    if text.startswith("@"):
        with open(text[1:], encoding="utf-8") as file:
            text = file.read()
    values = json.loads(text)
    if args.soc_method:
        values["soc_method"] = args.soc_method
    return Config.of(values)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    if spark is None:
        builder = SparkSession.builder.appName("cellwatch")
        for name, value in RECOMMENDED.items():
            builder = builder.config(name, value)
        spark = builder.getOrCreate()
    if read_telemetry(spark, args.source, args.start, args.end).isEmpty():
        print(f"no telemetry from {args.start} to {args.end}")
        return 0
    run = run_batch(
        spark, args.source, args.target, args.start, args.end, read_grids(spark, args.grids),
        parameters(args), args.tiebreak,
        states=spark.read.parquet(args.states_in) if args.states_in else None, mode=args.mode)
    if args.states_out:
        run.states.write.mode("overwrite").parquet(args.states_out)
    if args.failed:
        run.failed.write.mode("overwrite").parquet(args.failed)
    failed = run.failed.count()
    run.close()
    print(f"{failed} orders failed" if failed else "all orders processed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
