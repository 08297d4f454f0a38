"""Leaving texts in place while some of them are looked for by id.

A join of the corpus with a list of ids moves every text, unless the list is small enough for Spark to broadcast. Here
the ids set bits in a bitmap of bounded size, which is built by Spark's bitmap aggregates and broadcast; rows whose bit is
not set have none of the ids, and only the others are joined. A list of few ids gets a small bitmap, since the driver and
every executor keep a file of it; with very many ids more rows pass and are told apart by the join, so results do not
depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of the bitmap (16 MB), in buckets as Spark's bitmap functions make them.
BITS, BUCKET = 1 << 27, 32_768
#: A bitmap is halved down to LEAST_BITS while at most one bit in SPARSE is set afterwards.
LEAST_BITS, SPARSE = 1 << 20, 128


def place(doc_id: Column) -> Column:
    """The bit of an id; a null id has one too."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(BITS))


def bits_of(ids: DataFrame, column: str) -> Broadcast:
    """The bitmap of the ids in a column, as bytes; at most 4096 rows of 4 KB come to the driver."""
    spot = place(F.col(column)) + 1  # Spark counts from 1
    rows = ids.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    table, held = np.zeros((BITS // BUCKET, BUCKET // 8), dtype=np.uint8), 0
    # the iterator runs one job for each partition
    for row in rows.withColumn("held", F.bitmap_count("bits")).coalesce(16).toLocalIterator():
        table[row.bucket - 1] = np.frombuffer(row.bits, dtype=np.uint8)
        held += row.held
    return ids.sparkSession.sparkContext.broadcast(halved(table.ravel(), held))


def halved(bits: np.ndarray, held: int) -> np.ndarray:
    """The bitmap of the same ids by their places modulo a smaller power of two, if ``held`` set bits are few in that."""
    while len(bits) * 4 >= max(LEAST_BITS, held * SPARSE):
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def is_set(bits: np.ndarray, places: pa.Array) -> np.ndarray:
    at = places.to_numpy() & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split(
    docs: DataFrame, doc_id: Column, bits: Broadcast, wanted: bool, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """The rows of ``docs`` whose id has its bit set, or those whose id has not.

    ``then`` turns their batches into those of ``schema`` in the same Python worker: a second map would start another
    one for each task, with its own libraries and its own copy of the bitmap.
    """
    spot = "bit_place"
    while spot in docs.columns:
        spot += "_"
    schema, width = schema or docs.schema, len(docs.columns)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(is_set(bits.value, batch.column(width)) == wanted))
            if rows.num_rows:
                yield rows.select(list(range(width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from passing(batches) if then is None else then(passing(batches))

    return docs.withColumn(spot, place(doc_id)).mapInArrow(run, schema)
