"""Stage one: raw telemetry rows to a narrow feature row, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import Config
from ..functions import cells as C
from ..functions.interp import clamp, interp_1d, lookup, lower_node, with_location
from ..functions.parse import epoch_seconds, highest, pick_extreme, scalar_or_list, to_double, with_lists
from ..sources.grids import Grids

KEY = "orderid"
NEEDED = ("cell_min_volt", "cell_max_tem")


def cast_pack_columns(telemetry: DataFrame) -> DataFrame:
    """The two required pack columns as doubles, by Spark's cast; text that it cannot read becomes null."""
    return telemetry.withColumns({c: F.col(c).try_cast("double") for c in NEEDED})


def drop_incomplete(telemetry: DataFrame) -> DataFrame:
    """Leave out rows without the two required pack columns."""
    return telemetry.dropna(subset=list(NEEDED))


def pack_extremes(telemetry: DataFrame) -> DataFrame:
    """Add ``pack_max_volt`` and ``pack_min_tem`` from number-or-list columns."""
    schema = telemetry.schema
    return telemetry.withColumns({
        "pack_max_volt": scalar_or_list(F.col("cell_max_volt"), schema["cell_max_volt"].dataType, largest=True),
        "pack_min_tem": scalar_or_list(F.col("cell_min_tem"), schema["cell_min_tem"].dataType, largest=False),
    })


def pack_features() -> dict[str, Column]:
    """Features of a row known only by its pack extremes."""
    top, low = F.col("pack_max_volt"), F.col("cell_min_volt")
    hot, cold = F.col("cell_max_tem"), F.col("pack_min_tem")
    return {
        "volt_min": top - 2 * (top - low),
        "volt_avg": low,
        "temp_max": hot,
        "temp_avg": (hot + cold) / 2,
        "temp_ambient": cold,
        "temp_id": F.lit(1).cast("long"),
    }


def _cell_features() -> dict[str, Column]:
    """Features of a row with cell arrays; ``volts`` and ``temps`` hold them."""
    both_volts_zero = (F.col("low_volt") == 0) & (F.col("rest_volt") == 0)
    both_temps_zero = (F.col("high_temp") == 0) & (F.col("rest_temp") == 0)
    return {
        "volt_min": F.when(both_volts_zero, F.col("cell_min_volt")).otherwise(F.col("low_volt")),
        "volt_avg": F.when(both_volts_zero, (F.col("pack_max_volt") + F.col("cell_min_volt")) / 2)
        .otherwise(F.col("rest_volt")),
        "temp_max": F.when(both_temps_zero, F.col("cell_max_tem")).otherwise(F.col("high_temp")),
        "temp_avg": F.when(both_temps_zero, (F.col("cell_max_tem") + F.col("pack_min_tem")) / 2)
        .otherwise(F.col("rest_temp")),
        "temp_ambient": F.col("low_temp"),
        "temp_id": C.index_of(F.col("temps"), F.col("high_temp")).cast("long"),
    }


def features(telemetry: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature rows of complete telemetry rows.

    ``error`` is null on good rows and otherwise names what made the row, and
    with it its order, unusable.  Columns in ``keep`` pass through.
    """
    schema = telemetry.schema
    complete = drop_incomplete(cast_pack_columns(telemetry))
    parsed = pack_extremes(with_lists(complete, {"cells": "bmv_singlevolt", "temps": "bmt_singletemp"}))
    # An unreadable text list counts as missing, an unreadable array as an error.
    sizes, broken_array = [], F.lit(False)
    for raw, read in (("bmv_singlevolt", "cells"), ("bmt_singletemp", "temps")):
        is_array = isinstance(schema[raw].dataType, T.ArrayType)
        sizes.append(F.coalesce(F.size(raw if is_array else read), F.lit(0)))
        if is_array:
            broken_array = broken_array | F.col(read).isNull()
    no_cells = (sizes[0] == 0) | (sizes[1] == 0)
    routed = parsed.withColumn("pack_only", no_cells).withColumns({
        "volts": C.repair_low(F.col("cells")),
        "epoch": epoch_seconds(F.col("reltime"), schema["reltime"].dataType, listed=F.col("pack_only")),
        "measured": to_double(F.col("bcs_currentmeasure"), schema["bcs_currentmeasure"].dataType),
    })
    reduced = routed.withColumns({
        "low_volt": F.array_min("volts"),
        "high_temp": highest(F.col("temps")),
        "low_temp": pick_extreme(F.col("temps"), largest=False),
    }).withColumns({
        "rest_volt": C.mean_without(F.col("volts"), F.col("low_volt")),
        "rest_temp": C.mean_without(F.col("temps"), F.col("high_temp")),
    })
    pack, cell = pack_features(), _cell_features()
    merged = reduced.select(
        *keep, F.col(KEY).cast("string").alias(KEY), "batteryid", "reltime", "dt", "epoch", "pack_only",
        *[F.when(F.col("pack_only"), pack[n]).otherwise(cell[n]).alias(n) for n in pack],
        (-F.col("measured")).alias("current"),
        F.coalesce(
            F.when(F.col("pack_max_volt").isNull(), F.lit("cell_max_volt unreadable")),
            F.when(F.col("pack_min_tem").isNull(), F.lit("cell_min_tem unreadable")),
            F.when(F.col("measured").isNull(), F.lit("bcs_currentmeasure unreadable")),
            F.when(~F.col("pack_only") & broken_array, F.lit("cell array unreadable")),
            F.when(F.col("epoch").isNull(), F.lit("reltime unreadable")),
        ).alias("error"),
    )
    return merged.withColumns({
        "delta_v": F.col("volt_avg") - F.col("volt_min"),
        "delta_t": F.col("temp_max") - F.col("temp_avg"),
    })


def rate_and_sign(current: Column, capacity: float) -> tuple[Column, Column]:
    """C-rate, and direction: 1 for charge, -1 for discharge and rest."""
    return F.abs(current / capacity), F.when(current > 0, 1).otherwise(-1)


def with_soc(feats: DataFrame, grids: Grids) -> DataFrame:
    """Add the state of charge of the average and of the weakest cell."""
    lo, hi = min(grids.ocv), max(grids.ocv)
    return feats.withColumns({
        "soc_avg": clamp(F.col("volt_avg"), lo, hi),
        "soc_min": clamp(F.col("volt_min"), lo, hi),
    }).withColumns({c: interp_1d(F.col(c), grids.ocv, grids.soc) for c in ("soc_avg", "soc_min")})


def with_cell_model(feats: DataFrame, grids: Grids, config: Config,
                    temp: str = "temp_avg", soc: str = "soc_avg") -> DataFrame:
    """Add resistances ``r0`` and ``r1``, time constant ``tao``, voltage ``ocv`` and slope ``dvds``.

    Looked up by temperature and by C-rate or state of charge; resistances and
    time constant have a table per direction of current.
    """
    rate, sign = rate_and_sign(F.col("current"), config.cell.capacity)
    located = feats.withColumns({"rate": rate, "sign": sign})
    for name, x, breaks in (("at_temp", temp, grids.temp), ("at_rate", "rate", grids.rate),
                            ("at_soc", soc, grids.soc)):
        located = with_location(located, name, F.col(x), breaks)
    # Charge and discharge tables lie one behind the other; a row starts in its own.
    discharging = (F.col("sign") < 0).cast("int")
    located = located.withColumns({
        "node_rate": lower_node("at_temp", "at_rate", grids.rate) + discharging * len(grids.temp) * len(grids.rate),
        "node_soc": lower_node("at_temp", "at_soc", grids.soc),
        "node_soc_directed": lower_node("at_temp", "at_soc", grids.soc)
        + discharging * len(grids.temp) * len(grids.soc),
    })

    def by_rate(name: str) -> Column:
        tables = [grids.tables[f"{name}_C"], grids.tables[f"{name}_D"]]
        return lookup(tables, "node_rate", "at_temp", "at_rate")

    def by_soc(name: str) -> Column:
        tables = [grids.tables[f"{name}_C"], grids.tables[f"{name}_D"]]
        return lookup(tables, "node_soc_directed", "at_temp", "at_soc")

    return located.withColumns({
        "r0": by_rate("TI2R0") * by_soc("TSOC2R0"),
        "r1": by_rate("TI2R1") * by_soc("TSOC2R1"),
        "tao": by_soc("TSOC2tao"),
        "ocv": lookup([grids.tables["TSOC2OCV"]], "node_soc", "at_temp", "at_soc"),
        "dvds": lookup([grids.tables["TSOC2dVdS"]], "node_soc", "at_temp", "at_soc"),
    }).drop("rate", "sign", "node_rate", "node_soc", "node_soc_directed",
            *[f"{n}_{p}" for n in ("at_temp", "at_rate", "at_soc") for p in ("i", "w")])
