"""Embedding rows as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers below this are exact in a double.
EXACT = 1 << 53


def quantised(table: DataFrame, vector: str = "embedding", *keep: str) -> DataFrame:
    """The columns named in `keep`, and x = floor(256 * c) for each component c as double, of the rows whose vector is whole.

    Rows without a vector, or with a null or non-finite component, go; so do those whose number of components isn't the
    most common one (of equally common ones the larger).
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(whole)
    sizes = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size(v) == d).select(*(F.col(f"`{k}`") for k in keep), F.transform(v, lambda c: F.floor(c * 256).cast("long")).alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of lists of equal length as one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)
