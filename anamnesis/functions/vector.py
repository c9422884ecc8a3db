"""Vectors as arrays: native column functions, and their block forms in numpy for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision; null for different lengths or a null side."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    total = F.aggregate(products, F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x))


def normalised(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; -1 for different lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(-1.0))


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow array of float arrays as rows, and which rows have ``dim`` components (the rest are zeros)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array(column.value_lengths().fill_null(-1))
    good = sizes == dim
    out = np.zeros((len(column), dim))
    if good.all() and len(column):
        out[:] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    elif good.any():
        out[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out, good


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)
