"""Whitening of vectors by a covariance that is put together from variances alone.

For two dimensions i and j, var(i + j) - var(i) - var(j) = 2 cov(i, j). So one pass sums exact squares of the
centred values of every dimension and of every sum of two dimensions; their variances give the whole covariance
matrix, exactly, as fractions. The driver holds d (d + 1) / 2 integers and decomposes the d by d matrix; the fit
list and the vectors stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.ship import ship
from varve.llm.vectors import integer_vectors, longs, magnitude, matrix, safe
from varve.sources.shared import written

#: Rows whose pair sums are squared at once.
STRIP = 1024
#: Exact sums travel as high and low parts of this base, each a decimal.
BASE = 10**18


@dataclass
class Moments:
    """Exact facts of a fit list of n vectors: sums, the integer centre, and squares about it.

    ``square[i, i]`` is the sum of (x_i - centre_i)^2, ``square[i, j]`` that of (x_i - centre_i + x_j - centre_j)^2.
    """

    n: int
    sums: list[int]
    centre: list[int]
    square: dict[tuple[int, int], int]

    def covariance(self) -> np.ndarray:
        """Polarisation; each variance takes off the square of what the integer centre leaves of the mean."""
        d, n = len(self.sums), self.n
        left = [s - n * c for s, c in zip(self.sums, self.centre)]
        # n^2 times the variance of a dimension, or of a sum of two
        one = [n * self.square[i, i] - left[i] ** 2 for i in range(d)]
        out = np.zeros((d, d))
        for i in range(d):
            out[i, i] = float(Fraction(one[i], n * n))
            for j in range(i + 1, d):
                two = n * self.square[i, j] - (left[i] + left[j]) ** 2
                out[i, j] = out[j, i] = float(Fraction(two - one[i] - one[j], 2 * n * n))
        return out


def pair_squares(y: np.ndarray) -> list[int]:
    """Sums over the rows of the squares of each dimension and of each sum of two, by rows of the upper triangle."""
    d, out = y.shape[1], []
    exact = safe(2 * magnitude(y), len(y))
    y = y.T.copy() if exact else y.T.astype(object)
    for i in range(d):
        both = y[i] + y[i:]
        both[0] = y[i]
        squares = np.einsum("ij,ij->i", both, both) if exact else (both * both).sum(axis=1)
        out += [int(v) for v in squares]
    return out


def moments(fit: DataFrame, d: int) -> Moments | None:
    """Facts of the fit list, by one pass for the sums and one for the squares; d rows and d (d + 1) / 2 rows come back."""
    found = fit.select(F.posexplode("x").alias("dim", "value")).groupBy("dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return None
    n, sums = found[0].n, [0] * d
    for row in found:
        sums[row.dim] = int(row.s)
    centre = [s // n for s in sums]
    given = fit.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            x = matrix(batch.column(0), d)
            for at in range(0, len(x), STRIP):
                part = pair_squares(centred(x[at : at + STRIP], given.value))
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            whole = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), whole(v // BASE for v in total), whole(v % BASE for v in total)], names=["pair", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "pair int, high decimal(38,0), low decimal(38,0)")
    names = [(i, j) for i in range(d) for j in range(i, d)]
    squares = parts.groupBy("pair").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return Moments(n, sums, centre, {names[r.pair]: int(r.high) * BASE + int(r.low) for r in squares})


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less the integer centre, exact."""
    if magnitude(x) + max(map(abs, centre)) < 1 << 62:
        return x - np.array(centre, dtype=np.int64)
    return x.astype(object) - np.array(centre, dtype=object)


@dataclass
class Whitening:
    """Mean as integer centre and rest in [0, 1); the kept eigenvectors as columns, eigenvalues, and the trace."""

    n: int
    sums: list[int]
    centre: list[int]
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, one column per component."""
        return (centred(x, self.centre).astype(np.float64) - self.rest) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n * x - sum)^2, exact."""
        largest = self.n * magnitude(x) + max(map(abs, self.sums))
        kind = np.int64 if safe(largest, x.shape[1]) else object
        gap = self.n * x.astype(kind) - np.array(self.sums, dtype=kind)
        return (gap * gap).sum(axis=1)


def decompose(facts: Moments, components: int) -> Whitening:
    """Components by falling eigenvalue; the coordinate of largest size is positive. Those without variance are left out."""
    covariance = facts.covariance()
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    real = values > len(covariance) * np.finfo(float).eps * max(float(values[0]), 0.0) if len(values) else np.zeros(0, bool)
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    rest = np.array([float(Fraction(s - facts.n * c, facts.n)) for s, c in zip(facts.sums, facts.centre)])
    return Whitening(facts.n, facts.sums, facts.centre, rest, vectors, values, float(np.trace(covariance)))


def identity_error(fit: DataFrame, white: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, measured on the list."""
    c, d = white.vectors.shape[1], white.vectors.shape[0]
    given = fit.sparkSession.sparkContext.broadcast(white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(c), np.zeros((c, c))
        for batch in batches:
            w = given.value.project(matrix(batch.column(0), d))
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(c + c * c), pa.int32()), pa.array(np.r_[first, second.ravel()])], names=["at", "value"])

    got = np.zeros(c + c * c)
    for row in fit.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        got[row["at"]] = row["value"]
    mean, second = got[:c] / white.n, got[c:].reshape(c, c) / white.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(c)).max())


def usual_length(vectors: DataFrame) -> int:
    """The length that most vectors have; the smaller one among equals, 0 without vectors."""
    row = vectors.groupBy(F.size("x").alias("length")).count().where("length > 0").orderBy(F.desc("count"), "length").first()
    return row["length"] if row else 0


def whiten(df: DataFrame, components: int = 4, dimensions: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are dropped; entries become x = floor(256 * c). The fit
    list is each distinct x once, n of them. ``dimensions`` is the length of the vectors (by default the one most
    have); others, empty ones among them, are left out. Components run up to ``components``, the number of
    dimensions, and the rank of the fit list: a direction without variance has no row, so an empty table, one
    vector or equal vectors give none. Repeated rows and null ids give a row each. A deviation beyond a long is
    null. Other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    vectors = integer_vectors(df, id_column, vector_column)
    d = usual_length(vectors) if dimensions is None else dimensions
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = vectors.where(F.size("x") == d)
    # copies are combined before the shuffle, however many there are
    fit = written(vectors.select("x").distinct(), "whitening-fit")
    facts = moments(fit, d) if d else None
    white = decompose(facts, components) if facts else None
    if white is None or not len(white.values):
        return spark.createDataFrame([], schema)
    given, error = spark.sparkContext.broadcast(white), identity_error(fit, white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = given.value, len(given.value.values)
        for batch in batches:
            x = matrix(batch.column(1), d)
            rows = np.repeat(np.arange(len(x)), c)
            every = lambda values: pa.array(np.tile(values, len(x)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, c + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(rows), w.n), pa.int64()),
                    longs(w.deviation(x)).take(pa.array(rows)),
                    pa.array(w.project(x).ravel()),
                    every(w.values / w.trace),
                    pa.array(np.full(len(rows), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)
