"""Linear and bilinear table lookup as column expressions.

Breaks and grids are small configuration, so they enter the plan as literals:
a break search is a sum of comparisons and a corner is an ``element_at`` on a
literal array, both of which stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

NAN = float("nan")


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Limit ``x`` to ``[lo, hi]``; NaN stays NaN."""
    return F.when(F.isnan(x), x).when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def _literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def interp_1d(x: Column, breaks: Sequence[float], values: Sequence[float]) -> Column:
    """Piecewise linear through the points; the end pieces extend outwards."""
    points = list(zip(breaks, values))
    pieces = [
        F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit(float(y1 - y0)) / F.lit(float(x1 - x0))
        for (x0, y0), (x1, y1) in zip(points, points[1:])
    ]
    result = F.when(F.isnan(x), F.lit(NAN))
    for upper, piece in zip(breaks[1:-1], pieces):
        result = result.when(x < F.lit(float(upper)), piece)
    return result.otherwise(pieces[-1])


def left_break(x: Column, breaks: Sequence[float]) -> Column:
    """Zero-based index of the break at or left of ``x``, which is inside the breaks."""
    index = F.lit(0)
    for b in breaks[1:-1]:
        index = index + (x >= F.lit(float(b))).cast("int")
    return index


def with_location(df: DataFrame, name: str, x: Column, breaks: Sequence[float]) -> DataFrame:
    """Add ``name_i`` and ``name_w``: the interval that holds ``x``, and its share of it.

    Columns in steps, because a lookup uses each of them many times over.
    Outside the breaks the nearest edge counts.
    """
    at, index, points = F.col(f"{name}_x"), F.col(f"{name}_i"), _literal(breaks)
    share = (at - F.get(points, index)) / (F.get(points, index + 1) - F.get(points, index))
    return (
        df.withColumn(f"{name}_x", clamp(x, breaks[0], breaks[-1]))
        .withColumn(f"{name}_i", left_break(at, breaks))
        .withColumn(f"{name}_w", share)
        .drop(f"{name}_x")
    )


def lower_node(x: str, y: str, y_breaks: Sequence[float]) -> Column:
    """Position of the lower left node of a located point in a flattened grid."""
    return F.col(f"{x}_i") * len(y_breaks) + F.col(f"{y}_i")


def lookup(grids: Sequence[np.ndarray], node: str, x: str, y: str) -> Column:
    """Bilinear value at a located point.

    ``grids`` are tables of one shape, flattened one behind the other;
    ``node`` is the position of the point's lower left node among them.
    """
    height = grids[0].shape[1]
    flat = _literal(np.concatenate([g.reshape(-1) for g in grids]))
    at, wx, wy = F.col(node), F.col(f"{x}_w"), F.col(f"{y}_w")
    low = F.get(flat, at) * (1 - wx) + F.get(flat, at + height) * wx
    high = F.get(flat, at + 1) * (1 - wx) + F.get(flat, at + height + 1) * wx
    return low * (1 - wy) + high * wy
