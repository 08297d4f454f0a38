"""Vectors as exact integers, and their Arrow batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the integer grid in a unit.
SCALE = 256


def usable(vector: Column) -> Column:
    """The vector is there and every entry is a finite number."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, entry), F.lit(False))


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id long and x array<long>, floor(scale * entry) of the entry as a double, of every usable vector.

    Entries beyond a long take its nearest limit. Other columns are left behind, whatever their names.
    """
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    kept = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), vector.alias("v")).where(usable(F.col("v")))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column whose lists all have ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def safe(largest: int, terms: int) -> bool:
    """A sum of ``terms`` squares of numbers up to ``largest`` fits 64 bits."""
    return largest * largest * max(terms, 1) < 1 << 62


def magnitude(values: np.ndarray) -> int:
    """The largest absolute value, as a Python number."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


def longs(values: np.ndarray) -> pa.Array:
    """Integers as a long column; those beyond a long are null."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, but for the last one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(rows - n, batch.num_rows - at))
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
