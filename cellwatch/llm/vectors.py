"""What the operators on embeddings share: which rows take part, and arrays from Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector is not null, not zero, and holds finite numbers only."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def width(vectors: DataFrame) -> int:
    """The longest length; shorter vectors count as if zeros followed."""
    return vectors.agg(F.max(F.size("embedding")).alias("n")).collect()[0]["n"] or 0


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """A double matrix from a column of arrays without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dimensions).all():
        return flat.reshape(len(lengths), dimensions)
    out = np.zeros((len(lengths), dimensions))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def rows_of(frame, name: str, dtype, dimensions: int) -> np.ndarray:
    """A matrix from a pandas column of raw bytes."""
    return np.frombuffer(b"".join(frame[name]), dtype).reshape(len(frame), dimensions).astype(np.float64)
