"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """True for an array that is not null and holds neither null nor a non-finite number."""
    return F.coalesce(vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector is finite and of the usual length (that of most finite vectors, of equally many the longest), and that length; 0 where there is no such row."""
    kept = df.where(is_finite(F.col(f"`{vector}`")))
    size = F.size(F.col(f"`{vector}`"))
    usual = kept.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dim = usual["size"] if usual else 0
    return kept.where(size == dim), dim


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column without nulls as an array of rows."""
    return np.asarray(column.flatten()).reshape(len(column), dim)
