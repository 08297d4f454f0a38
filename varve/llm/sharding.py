"""Shuffling a corpus into shards by two passes, neither of which holds more than one bucket in memory.

Pass one scatters the rows over buckets by a seeded hash of the whole row (Spark's shuffle files are the
external store). Pass two reads each bucket alone, brings it into a fixed order, shuffles it by Fisher-Yates
with the bucket's own seed and writes it. The sequence of all buckets is one random order of the corpus; it
is cut into shards whose row counts differ by one at most (the law ``rows``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.ship import ship
from varve.sources.shared import scratch, written

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
LAW = "rows"
#: Equal rows that may share a bucket.
COPIES = 4096


def size_of(text: str = "text"):
    """UTF-8 bytes of the text (null: none) and a fixed share for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def shuffle_to_shards(
    docs: DataFrame, shards: int = 40, seed: int = 7, bucket_bytes: int = 64 << 20, least_per_shard: int = 4, path: str | None = None
) -> DataFrame:
    """Write ``docs`` in random order as Parquet folders shard=0..shards-1 and return the table read back.

    All columns stay; ``shard`` and ``slot`` (gapless from 0 in each shard, the order of the rows in the
    shard's files) are added and replace columns of those names. The number of buckets follows from the total
    size: about ``bucket_bytes`` each, at least ``least_per_shard`` for each shard. The same rows, seed and
    number of shards give the same result whatever the partitioning, so a lost executor's tasks come out alike
    when they run again. Null texts and ids are values like any other; equal texts need not meet in a shard.
    Rows equal in all columns are interchangeable; up to ``COPIES`` of them share a bucket, more are spread over all.
    One count for each bucket comes to the driver. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("shard", "slot")
    kept = docs.schema
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").cast("string") for c in docs.columns])
    total = docs.agg(F.sum(size_of()).alias("bytes")).first()["bytes"] or 0
    buckets = max(shards * least_per_shard, math.ceil(total / bucket_bytes))
    keyed = salted(docs.select(F.struct("*").alias("row"), key.alias("key")), seed).withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(buckets)).cast("int"))
    # one number for each bucket, and buckets are counted by bytes over bucket_bytes
    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        counts[bucket] = n
    rows = int(counts.sum())
    first_of = spark.sparkContext.broadcast(np.cumsum(counts) - counts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        keys, bucket = table.column("key").to_numpy(), int(table.column("bucket")[0].as_py())
        order = np.argsort(keys, kind="stable")
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # Fisher-Yates
        index = first_of.value[bucket] + np.arange(len(order), dtype=np.int64)
        shard = index * shards // rows
        slot = index - -(-shard * rows // shards)
        out = table.select(["row"]).take(pa.array(order)).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))
        yield from out.to_batches(max_chunksize=4096)

    schema = T.StructType([T.StructField("row", kept), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    dealt = keyed.repartitionById(buckets, F.col("bucket")).mapInArrow(deal, schema)
    path = path or scratch(spark, "shards")
    dealt.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = T.StructType([*kept.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(back).parquet(path).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")


def salted(keyed: DataFrame, seed: int, copies: int = COPIES) -> DataFrame:
    """Rows (row, key) where the copies of a row that comes more than ``copies`` times have keys of their own.

    Such rows are combined before they are moved, counted, and dealt out again with a number each, so that their
    copies spread over all buckets, the same way whatever the partitioning.
    """
    hot = written(keyed.groupBy(F.col("key").alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > copies).select("hot"), "shard-hot")
    if hot.isEmpty():
        return keyed
    # the key is 64 bits of the row: rows that share it are told apart by their values
    groups = keyed.join(hot, F.col("key") == F.col("hot"), "left_semi").groupBy("key", "row").agg(F.count(F.lit(1)).alias("n"))
    dealt = groups.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth")).select("row", F.xxhash64("key", "nth", F.lit(seed)).alias("key"))
    return keyed.join(hot, F.col("key") == F.col("hot"), "left_anti").unionByName(dealt)


def shard_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document, derived from the written shards: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 16 and the checksum of an empty text; grown_shard belongs to another law and is null.
    """
    return shuffle_to_shards(docs, **options).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size_of().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
