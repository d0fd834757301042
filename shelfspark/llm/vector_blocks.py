"""Vectors as integers, packed in blocks of bounded size, and exact products of two blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest absolute value of a component; products of vectors of 500 such components still fit 64 bits.
LARGEST = 1 << 27


def whole_vectors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as array<int>; null unless all are finite and at most ``LARGEST``."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / scale, F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of int arrays of one length."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0), np.int32)


def small(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest of them takes; the first byte tells how many."""
    values = np.asarray(values, np.int64)
    most = max(int(values.max()), -1 - int(values.min())) if values.size else 0
    size = next(n for n in (1, 2, 4, 8) if most < 1 << 8 * n - 1)
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def large(data: bytes) -> np.ndarray:
    """The numbers of ``small``, flat."""
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def packed(rows: np.ndarray) -> bytes:
    return small(rows)


def unpacked(data: bytes, rows: int) -> np.ndarray:
    return large(data).astype(np.int32).reshape(rows, -1) if rows else np.zeros((0, 0), np.int32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of ``a`` and ``b`` as 64-bit integers, by floats where these are exact."""
    most = lambda x: int(np.abs(x).max()) if x.size else 0
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def renewed(df: DataFrame) -> DataFrame:
    """``df`` with columns of their own, so that it can meet a table of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def first_of_each(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark also applies the limit before the shuffle."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
