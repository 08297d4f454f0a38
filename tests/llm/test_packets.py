"""Packets of op12: their bytes, the files they lie in, and what of them goes to Python."""

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from varve.llm import exactdup
from varve.sources import shared


def test_packets_are_cut_by_bytes_within_a_batch():
    rng = random.Random(3)
    texts = [rng.randrange(200) * "b" for _ in range(3000)] + ["x" * 50_000, None]
    of = lambda low, high: pa.RecordBatch.from_arrays([pa.array(range(low, high)), pa.array(["s" * 64] * (high - low)), pa.array(range(low, high)), pa.array(texts[low:high], pa.string())], names=["id", "sha", "print", "body"])
    for cuts in ([0, 3002], [0, 1, 2, 700, 2990, 3002]):
        for most, size in ((1 << 16, 4096), (7, 4096), (100, 1 << 20), (1 << 16, 1)):
            got = list(exactdup.packed((of(a, b) for a, b in zip(cuts, cuts[1:])), most, size))
            assert [x for b in got for x in b.column("id").to_pylist()] == list(range(3002))
            assert [x for b in got for x in b.column("body").to_pylist()] == texts
            weights = [[80 + len(x or "") for x in b.column("body").to_pylist()] for b in got]
            assert all(len(w) <= most and sum(w[:-1]) < size for w in weights)
            assert all(len(w) == most or sum(w) >= size for w in weights[:-1])


def test_packets_share_files_in_small_row_groups(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id", F.repeat(F.lit("!"), 10_000)).alias("text"))
    table = shared.bucketed(exactdup.packets(docs, 48, 1 << 16, 1 << 20), "packets", "lot", 2, **exactdup.ROW_GROUPS)
    files = [pq.ParquetFile(f).metadata for f in Path(table._written_to.removeprefix("file:")).glob("*.parquet")]
    packets = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(packets) == 29 and len(files) <= 2 and max(packets) == 2
    shared.discard(table)


def test_marks_are_made_without_texts(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    table = exactdup.packets(docs, 48, 4, 1 << 20).localCheckpoint()
    answers = exactdup.replies(exactdup.messages(table, 2, 48), 2)
    rows = exactdup.marked(table, answers, 2, 48, 2)
    steps = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert steps and not any("bodies" in line for line in steps)
    assert sorted((r.doc_id, r.suspect, r.body) for r in rows.collect()) == [(i, True, "same") for i in range(50)]
