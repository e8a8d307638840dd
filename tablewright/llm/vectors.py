"""Embedding columns as integer vectors, in numpy and in tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components must stay below this, so that sums of products fit into 64 bits.
LARGEST = 1 << 26


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or NaN component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; an error from LARGEST on."""
    floors = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    large = F.exists(vector, lambda x: F.abs(x.cast("double")) * scale >= LARGEST)
    error = F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more"))
    return F.when(large, error).otherwise(floors).cast("array<int>")


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix of int64; short rows are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    most = int(lengths.max()) if len(lengths) else 0
    width = most if width is None else max(width, most)
    if len(values) == len(lengths) * width:
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out
