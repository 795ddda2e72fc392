"""Vectors of an array column: which rows take part, and their numbers as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers are held within this, whatever a vector's entries are.
LIMIT = float(2**62)


def finite(column: str = "embedding") -> Column:
    """True where the vector has entries, none of them null, NaN or infinite."""
    ok = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & ok, F.lit(False))


def commonest_width(rows: DataFrame, column: str = "embedding") -> int:
    """The number of entries that most vectors have, the larger of equals; 0 where there is none."""
    found = rows.groupBy(F.size(column).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    best = found.agg(F.max(F.struct("n", "width"))["width"]).first()[0]
    return int(best or 0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row per vector, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def whole(values: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * value) as long; beyond LIMIT it is LIMIT."""
    return np.clip(np.floor(values * factor), -LIMIT, LIMIT).astype(np.int64)
