"""What the operators on whole vectors share: which rows take part, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integers beyond this count as this: up to here doubles hold them exactly.
MOST = 1 << 53
#: The largest 64-bit integer; sums of squares beyond it are given as this.
LONG = (1 << 63) - 1
MASK = (1 << 64) - 1


def finite_rows(vectors: DataFrame, *extra: str) -> DataFrame:
    """vec_id (long), embedding and the ``extra`` columns of rows whose vector is neither null nor holds null or non-finite components."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<float>" if single else "array<double>").alias("embedding"), *extra)
    return rows.filter(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def dimensions(rows: DataFrame) -> int:
    """Components of the longest vector; 0 in an empty table."""
    return rows.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) doubles of a list array without nulls; shorter vectors are padded with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    if (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long, at most ``MOST`` in absolute value."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64)


def integer_array(x: Column, scale: int, dim: int) -> Column:
    """The same of an array column, padded with zeros to ``dim``."""
    whole = F.transform(x, lambda v: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(v.cast("double") * scale).cast("double"))).cast("long"))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(x)))


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of a long matrix, of any size."""
    low = (x & 0xFFFFFFF).sum(axis=0)
    return [(int(h) << 28) + int(l) for h, l in zip((x >> 28).sum(axis=0), low)]
