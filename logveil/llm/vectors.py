"""Columns of vectors: which are usable, and how tasks read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there and every component is a finite number."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), odd)


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, the longer one in a tie; 0 if there is none.

    Lengths are counted in Spark; a handful of numbers comes back.
    """
    found = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return max(found["d"], 0) if found else 0


def matrix(column: pa.Array, d: int, kind=np.int64) -> np.ndarray:
    """A list column whose values all have d entries as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), d)
