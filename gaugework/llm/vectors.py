"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """True for vectors that are neither null, empty nor zero and hold only finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(column.isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows are filled with zeros up to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    rows = np.zeros((len(column), width))
    rows[np.arange(width)[None, :] < lengths[:, None]] = values
    return rows


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; dividing by the largest entry first keeps the squares in range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
