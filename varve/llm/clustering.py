"""Exact k-means on integer vectors whose dimension blocks are dictionary-encoded once.

The vectors of a task are cut into packs. A pack keeps, for every block of neighbouring dimensions, the distinct
subvectors and one code per vector, which loses nothing. Each round a pack computes the squared distance of every
distinct subvector to the matching part of every centroid once, and adds these partial distances up by code. The
packs are written once; only k centroids travel to them and only k partial sums come back, so nothing that is
broadcast or collected grows with the data. The width of the blocks is chosen for each pack by the work it takes;
all widths give the same distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.ship import ship
from varve.llm.vectors import gathered, integer_vectors, longs, magnitude, matrix, safe
from varve.sources.shared import written

PACK_ROWS = 4096
WIDTHS = (1, 2, 4, 8)
#: Vectors whose distances are summed at once, so that the sums stay in the processor's cache.
STRIP = 512

PACK_SCHEMA = "ids array<long>, width int, starts array<int>, entries array<long>, codes array<int>"


def encode(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts of the blocks' dictionaries, their subvectors one after the other, and codes (block by vector).

    A code counts from the first dictionary, so that one table of partial distances serves all blocks.
    """
    starts, entries, codes = [0], [], []
    for at in range(0, x.shape[1], width):
        block = np.ascontiguousarray(x[:, at : at + width])
        # rows of a block compare as one opaque value each
        _, first, code = np.unique(block.view([("", np.int64)] * width).ravel(), return_index=True, return_inverse=True)
        entries.append(block[first])
        codes.append(code.ravel() + starts[-1])
        starts.append(starts[-1] + len(first))
    return np.array(starts, np.int32), np.concatenate(entries), np.array(codes, np.int32)


def best_width(x: np.ndarray, widths: tuple[int, ...]) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The width with the least work for each centroid: entries times width, and one addition per vector and block."""
    best = None
    for width in widths:
        if x.shape[1] % width:
            continue
        packed = encode(x, width)
        work = packed[1].size + packed[2].size
        if best is None or work < best[0]:
            best = work, width, packed
        elif work > 2 * best[0]:
            break  # wider blocks have no fewer distinct subvectors
    return best[1], best[2]


def pack(vectors: DataFrame, dimensions: int, rows: int = PACK_ROWS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The encoded packs of ``vectors`` (vec_id, x), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, rows):
            width, (starts, entries, codes) = best_width(matrix(batch.column(1), dimensions), widths)
            of = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                    pa.array([width], pa.int32()),
                    of(starts, pa.int32()),
                    of(entries.ravel(), pa.int64()),
                    of(codes.ravel(), pa.int32()),
                ],
                names=["ids", "width", "starts", "entries", "codes"],
            )

    return vectors.mapInArrow(run, PACK_SCHEMA)


class Pack:
    """One pack read back."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        of = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
        self.ids, self.width = batch.column("ids")[row].values, batch.column("width")[row].as_py()
        self.starts, self.entries = of("starts"), of("entries").reshape(-1, self.width)
        self.codes = of("codes").reshape(len(self.starts) - 1, -1)

    def partial(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances of every distinct subvector to its part of every centroid (entry by centroid)."""
        out = np.zeros((len(self.entries), len(centroids)), dtype=centroids.dtype)
        for block, (low, high) in enumerate(zip(self.starts[:-1], self.starts[1:])):
            for j in range(self.width):
                gap = self.entries[low:high, j].astype(centroids.dtype)[:, None] - centroids[None, :, block * self.width + j]
                out[low:high] += gap * gap
        return out

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector (the smaller one among equals) and the squared distance."""
        c = np.array(centroids, dtype=object)
        far = magnitude(self.entries) + max(abs(v) for row in centroids for v in row)
        table = self.partial(c.astype(np.int64) if safe(far, self.codes.shape[0] * self.width) else c)
        number, distance = [], []
        for at in range(0, self.codes.shape[1], STRIP):
            total = table[self.codes[0, at : at + STRIP]]
            for codes in self.codes[1:, at : at + STRIP]:
                total += table[codes]
            won = total.argmin(axis=1)
            number.append(won)
            distance.append(total[np.arange(len(won)), won])
        return np.concatenate(number), np.concatenate(distance)

    def sums(self, number: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of the vectors of each centroid: how often each code occurs, times its subvector."""
        blocks = len(self.codes)
        exact = np.int64 if safe(magnitude(self.entries), 1) and magnitude(self.entries) * self.codes.shape[1] < 1 << 62 else object
        out = np.zeros((k, blocks * self.width), dtype=exact)
        for block, (low, high) in enumerate(zip(self.starts[:-1], self.starts[1:])):
            size = int(high - low)
            times = np.bincount(number * size + (self.codes[block] - low), minlength=k * size).reshape(k, size)
            out[:, block * self.width : (block + 1) * self.width] = times.astype(exact) @ self.entries[low:high].astype(exact)
        return out


def packs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Pack(batch, row)


def one_round(packs: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Assign all vectors and move every centroid that has any to the floor of their mean."""
    spark, k = packs.sparkSession, len(centroids)
    given = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = None, np.zeros(k, dtype=np.int64)
        for p in packs_of(batches):
            number, _ = p.nearest(given.value)
            part = p.sums(number, k).astype(object)
            total = part if total is None else total + part
            counts += np.bincount(number, minlength=k)
        if total is None:
            return
        c, d = np.nonzero(np.repeat(counts[:, None] > 0, total.shape[1], axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array([Decimal(v) for v in total[c, d]], pa.decimal128(38, 0)), pa.array(counts[c], pa.int64())],
            names=["cluster", "dim", "total", "n"],
        )

    parts = packs.mapInArrow(run, "cluster int, dim int, total decimal(38,0), n long")
    moved = [list(c) for c in centroids]
    # k times d rows come back
    for row in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[row.cluster][row.dim] = int(row.total) // row.n
    return moved


def assign(packs: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    given = packs.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in packs_of(batches):
            number, distance = p.nearest(given.value)
            yield pa.RecordBatch.from_arrays([p.ids, pa.array(number, pa.int32()), longs(distance)], names=["vec_id", "cluster", "distance"])

    return packs.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose sha256 of ``seed:vec_id`` is smallest, in that order; null ids come last, equal ids by vector."""
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = vectors.select("x", turn.alias("turn")).orderBy(F.col("turn").asc_nulls_last(), "x").limit(k)
    return [list(r.x) for r in chosen.collect()]


def cluster(
    df: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, seed: int = 2, id_column: str = "vec_id", vector_column: str = "embedding", **packing
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite, as integers floor(256 * c).
    Repeated rows count as often as they come; with fewer than k vectors there are fewer centroids, without any
    there are none and no rows. Centroids without vectors stay where they are. A distance beyond a long is null,
    though its cluster is exact. Other columns are ignored.
    """
    spark: SparkSession = df.sparkSession
    ship(spark)
    vectors = integer_vectors(df, id_column, vector_column).where(F.size("x") == dimensions)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    packs = written(pack(vectors, dimensions, **packing), "cluster-packs")
    for _ in range(rounds):
        centroids = one_round(packs, centroids)
    return assign(packs, centroids), centroids


def cluster_digest(df: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The inertias are sums of the distances over the cluster and over all; one that holds a distance beyond a long,
    or is itself beyond one, is null. Rules as in ``cluster``.
    """
    spark = df.sparkSession
    rows, centroids = cluster(df, **options)
    rows = written(rows, "cluster-rows")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost"))
    total = per.agg(F.sum("s").alias("s"), F.sum("lost").alias("lost")).first()
    known = lambda value, lost: F.when(lost == 0, value).try_cast("long")
    # k rows, written so that Spark knows their size when they meet the vectors
    facts = per.join(names, "cluster").select(
        "cluster",
        known(F.col("s"), F.col("lost")).alias("cluster_inertia"),
        known(F.lit(total.s).cast("decimal(38,0)"), F.lit(total.lost)).alias("inertia"),
        "centroid_sha256",
    )
    facts = written(facts, "cluster-facts")
    return rows.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, dimensions: int = 64, seed: int = 2) -> str:
    """The rows of ``cluster_digest`` in DuckDB: the same rounds written out one after the other."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = {dimensions})""",
        "v AS MATERIALIZED (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM kept)",
        f"""seeds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS c, x FROM kept
  ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, x LIMIT {k})""",
        "c0 AS MATERIALIZED (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS d FROM seeds)",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM (
  SELECT r, c, sum((x - y) * (x - y))::BIGINT AS s FROM v JOIN c{i} USING (d) GROUP BY r, c) GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (SELECT a.c, v.d, sum(v.x)::BIGINT AS s, count(*) AS n FROM v JOIN a{i} a USING (r) GROUP BY a.c, v.d),
c{i + 1} AS MATERIALIZED (SELECT c, d, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{i} LEFT JOIN m{i} USING (c, d))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f""",
names AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN names USING (c)"""
    )
