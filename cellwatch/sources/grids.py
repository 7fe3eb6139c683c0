"""Lookup grids of the cell model.

A grid table is long and small: ``grid string, ix int, iy int, x double,
y double, z double``; one-dimensional breaks leave ``iy`` and ``y`` null and
keep their value in ``x``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, SparkSession

GRID_SCHEMA = "grid string, ix int, iy int, x double, y double, z double"

# Fixed names: the arrays a cell model consists of.
BREAKS = ("T_break", "CRate_break", "SOC_break", "OCV_break")
RATE_GRIDS = ("TI2R0_C", "TI2R1_C", "TI2R0_D", "TI2R1_D")
SOC_GRIDS = ("TSOC2R0_C", "TSOC2R1_C", "TSOC2tao_C", "TSOC2R0_D", "TSOC2R1_D", "TSOC2tao_D",
             "TSOC2OCV", "TSOC2dVdS")
MIRRORED = ("TSOC2tao_C", "TSOC2tao_D")

@dataclass(frozen=True)
class Grids:
    """Breaks and grids in memory, tau grids already mirrored along SOC."""

    breaks: dict[str, tuple[float, ...]]
    tables: dict[str, np.ndarray]

    @property
    def temp(self):
        return self.breaks["T_break"]

    @property
    def rate(self):
        return self.breaks["CRate_break"]

    @property
    def soc(self):
        return self.breaks["SOC_break"]

    @property
    def ocv(self):
        return self.breaks["OCV_break"]


def load_grids(table: DataFrame) -> Grids:
    """Collect a grid table once, after a count by grid has shown that it has the shape of one."""
    known = [*BREAKS, *RATE_GRIDS, *SOC_GRIDS]
    name = F.when(F.col("grid").isin(known), F.col("grid"))
    sizes = {r["name"]: r["rows"] for r in table.groupBy(name.alias("name")).agg(F.count("*").alias("rows")).collect()}
    if None in sizes:
        raise ValueError("not a lookup grid table: it has rows of other names")
    missing = [n for n in known if n not in sizes]
    if missing:
        raise ValueError(f"lookup grid table lacks {missing}")
    for grid in (*RATE_GRIDS, *SOC_GRIDS):
        across = "CRate_break" if grid in RATE_GRIDS else "SOC_break"
        if sizes[grid] > sizes["T_break"] * sizes[across]:
            raise ValueError(f"lookup grid {grid} has more rows than its breaks have nodes")
    return _assemble(table.select("grid", "ix", "iy", "x", "z").collect())


def _assemble(rows) -> Grids:
    """Grids of ``(grid, ix, iy, x, z)`` rows."""
    breaks: dict[str, dict[int, float]] = {}
    cells: dict[str, dict[tuple[int, int], float]] = {}
    for name, ix, iy, x, z in rows:
        if name in BREAKS:
            breaks.setdefault(name, {})[ix] = x
        else:
            cells.setdefault(name, {})[ix, iy] = z
    missing = [n for n in BREAKS if n not in breaks] + [n for n in RATE_GRIDS + SOC_GRIDS if n not in cells]
    if missing:
        raise ValueError(f"lookup grid table lacks {missing}")
    tables = {}
    for name, values in cells.items():
        shape = tuple(1 + max(axis) for axis in zip(*values))
        grid = np.full(shape, np.nan)
        for (ix, iy), z in values.items():
            grid[ix, iy] = z
        if np.isnan(grid).any():
            raise ValueError(f"lookup grid {name} has holes")
        tables[name] = grid[:, ::-1].copy() if name in MIRRORED else grid
    return Grids({n: tuple(v for _, v in sorted(b.items())) for n, b in breaks.items()}, tables)


def write_grids(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def read_grids(spark: SparkSession, path: str) -> Grids:
    return load_grids(spark.read.schema(GRID_SCHEMA).parquet(path))


# Test values of our own, stated by formula so that SQL can state them too.
SAMPLE_BREAKS = {
    "T_break": (-20.0, 0.0, 25.0, 60.0),
    "CRate_break": (0.0, 0.5, 1.0, 4.0),
    "SOC_break": (0.0, 0.05, 0.15, 0.9, 0.95, 1.0),
    "OCV_break": (3.0, 3.3, 3.4, 3.5, 3.6, 4.2),
}


# Curved between nodes and other for charge than for discharge, so that a wrong node or table shows; the odd
# factors keep values off the middle between two rounded ones.
SAMPLE_FORMULAS = {
    "R0_C": lambda x, y: 0.002 * (1 + 0.917364813 * y * y) * (1 - x / 200),
    "R0_D": lambda x, y: 0.003 * (2 - 0.051736481 * y * y) * (1 + x * x / 9000),
    "R1_C": lambda x, y: 0.001 * (1 + y + 0.817364813 * y * y) * (1 - x / 200),
    "R1_D": lambda x, y: 0.0015 * (1 + 0.517364813 * y * y) * (1 + x * x / 8000),
    "tao_C": lambda x, y: 20 + 40 * y + 0.0917364813 * (x + 20) * y * y,
    "tao_D": lambda x, y: 30 + 25.17364813 * y * y + x / 10,
    "OCV": lambda x, y: 3.2 + 0.5 * y + 0.1173648129 * y * y + 0.0000053719 * x * x,
    "dVdS": lambda x, y: 0.6 + 0.3173648129 * y * y + 0.001 * x,
}


def _sample_rows() -> list[tuple]:
    """Rows of the sample grid table in the columns of ``GRID_SCHEMA``."""
    rows = [(name, i, None, x, None, None) for name, values in SAMPLE_BREAKS.items() for i, x in enumerate(values)]
    for name in RATE_GRIDS + SOC_GRIDS:
        formula = SAMPLE_FORMULAS[name.split("2")[1]]
        y_axis = SAMPLE_BREAKS["CRate_break" if name in RATE_GRIDS else "SOC_break"]
        for ix, x in enumerate(SAMPLE_BREAKS["T_break"]):
            rows += [(name, ix, iy, x, y, float(formula(x, y))) for iy, y in enumerate(y_axis)]
    return rows


def sample_grid_table(spark: SparkSession) -> DataFrame:
    """The grid table that tests and registered queries use."""
    return spark.createDataFrame(_sample_rows(), GRID_SCHEMA)


def sample_grids() -> Grids:
    return _assemble((name, ix, iy, x, z) for name, ix, iy, x, _, z in _sample_rows())
