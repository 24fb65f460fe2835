"""Vectors as rows: which ones take part, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def sample(df: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """At most ``most`` vectors of the most common length, those with the smallest hash of the id."""
    size = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not size:
        return np.zeros((0, 1))
    most = max(2, min(most, 4_000_000 // size["d"]))
    rows = df.where(F.size(vector) == size["d"]).orderBy(F.xxhash64(key), key).limit(most).select(vector).toArrow()
    return matrix(rows[vector])
