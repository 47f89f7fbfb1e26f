"""Rows with usable vectors, as compact binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``rows`` without those whose key or vector is null, empty, zero or holds null or non-finite components."""
    v, bad = F.col(f"`{vector}`"), F.lit(float("inf"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bad)) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(f"`{key}`").isNotNull() & v.isNotNull() & F.coalesce(ok, F.lit(False)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a double-precision matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))
