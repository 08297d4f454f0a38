"""Bounds on memory and rows that hold whatever one text, item or group weighs."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varve.llm import decontaminate, fingerprints, idfilter, language, neardup, quality, sharding
from varve.llm.textbytes import slabs
from varve.sources import shared


def test_quality_walks_long_texts_in_runs():
    net, rng = quality.Network.new(3), np.random.default_rng(0)
    for n in (1, 16, 511, 513, quality.RUN_BYTES - 1, quality.RUN_BYTES + 1, 2 * quality.RUN_BYTES + 5, 400_001):
        data = rng.integers(0, 256, n).astype(np.uint8)
        b = quality.blocks(data, np.array([0, n]))
        whole = net.head(quality.pool(net.chunk_maxima(b), b.text, 1))[1]
        assert net.scores(data, np.array([0, n])) == pytest.approx(whole, abs=1e-6)
    long = np.resize(data, 30 << 20)
    tracemalloc.start()
    net.scores(long, np.array([0, len(long)]))
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_keep_good_without_labels_of_both_kinds_keeps_all(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 3 else None) for i in range(20)], "doc_id long, text string").withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    for given in (labels.limit(0), labels):
        kept = quality.keep_good(docs, given)
        assert kept.count() == 20 and kept.columns == docs.columns
    both = labels.withColumn("quality", F.col("doc_id").cast("int") % 2)
    assert quality.keep_good(docs.limit(0), both).count() == 0


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(4, f"copy {i}") for i in range(30)] + [(5, "y" * 5000), (8, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (8, 0)], "doc_id long, quality int")
    texts, marks = quality.training_rows(docs, labels, rows=3, total_bytes=1 << 20, longest=1000)
    assert len(texts) == len(marks) <= 3 and max(map(len, texts)) <= 1000


def test_other_items_and_blocks_do_not_change_an_items_hits(spark):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate((32, 20, 60, 7, 130))]
    scattered = [x for k in range(0, 32, 10) for x in (*items[0][1].split()[k : k + 10], *say(60))]
    docs = spark.createDataFrame([(0, " ".join(scattered))] + [(i + 1, " ".join([*say(300), *t.split(), *say(50)])) for i, t in items], "doc_id long, text string")
    found = lambda given, **o: {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap, r.first_word, r.score) for r in decontaminate.contaminated(docs, spark.createDataFrame(given, "item_id long, text string"), **o).collect()}
    alone = found(items)
    assert set(alone) == {(i + 1, i) for i, _ in items}
    assert found(items, block_words=50) == alone
    beside = found([*items, (9, " ".join(say(2000)))])
    assert {k: v[:3] for k, v in beside.items()} == {k: v[:3] for k, v in alone.items()}
    assert all(abs(beside[k][3] - alone[k][3]) < 0.05 for k in alone)


def test_a_row_that_fills_a_third_of_the_table_spreads_over_buckets(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot row").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    keyed = df.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    spread = sharding.salted(keyed, 7, copies=100)
    assert spread.count() == 9000 and spread.select("key").distinct().count() == 9000
    assert sorted(r.row.doc_id for r in spread.select("row").collect()) == sorted(r.doc_id for r in df.collect())
    again = sharding.salted(keyed.repartition(7), 7, copies=100)
    assert sorted(r.key for r in again.select("key").collect()) == sorted(r.key for r in spread.select("key").collect())


def test_an_id_that_fills_a_third_of_the_table_spreads_over_blocks(spark):
    rows = [(i if i % 3 else 50, f"text number {i}") for i in range(1, 1501)] + [(None, f"none {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    blocked = fingerprints.in_order(docs, block_bytes=1024).collect()
    order = sorted(blocked, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.tie))
    blocks = [r.block for r in order]
    assert blocks == sorted(blocks)
    sizes = {}
    for b in blocks:
        sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values()) < 200
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.compare_with_edits(docs).collect()}
    want = set()
    for i, r in enumerate(order):
        half = len(r.text) // 2
        want.add((r.doc_id, len(r.text), hashlib.sha256((r.text[: len(r.text) - half] + order[(i + 1) % len(order)].text[:half]).encode()).hexdigest()))
    assert got == want


def test_every_one_of_many_languages_has_landmarks():
    rng = random.Random(8)
    alphabet = [chr(0x61 + i) for i in range(26)] + [chr(0x100 + i) for i in range(60)]
    own = {f"l{k:03}": ["".join(rng.choice(alphabet) for _ in range(4)) for _ in range(12)] for k in range(200)}
    texts, names = [], []
    for _ in range(4):
        for name, vocabulary in own.items():
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(40)))
            names.append(name)
    model = language.fit(texts, names)
    assert model.languages == sorted(own) and model.landmarks.shape[1] == 400
    fresh = [" ".join(rng.choice(v) for _ in range(40)) for v in own.values()]
    best, _ = model.predict(next(slabs(pa.array(fresh, pa.large_string()), 1 << 30)))
    assert np.mean([model.languages[b] == n for b, n in zip(best, own)]) > 0.98


def test_rows_are_told_apart_by_the_bits_of_their_ids(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, f"t{i}", i) for i in range(500)], "doc_id long, text string, bit_place int")
    ids = spark.createDataFrame([(i,) for i in (3, 5, 5, 499)] + [(None,)], "of long")
    bits = idfilter.bits_of(ids, "of")
    assert int(np.unpackbits(bits.value).sum()) == 4
    inside, outside = (idfilter.split(docs, F.col("doc_id"), bits, w) for w in (True, False))
    assert {r.doc_id for r in inside.collect()} == {3, 5, 499, None} and inside.columns == docs.columns
    assert inside.count() + outside.count() == 500
    assert idfilter.split(docs, F.col("doc_id"), idfilter.bits_of(ids.limit(0), "of"), True).count() == 0


def test_sketches_and_sets_of_some_classes_leave_the_rest_in_place(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(12))) for i in range(60)] + [(60, ""), (61, None)], "doc_id long, text string").coalesce(1)
    table = shared.written(neardup.sketches(docs, 5), "test-sketch")
    search = neardup.Search(docs, table, 5, 80, 100)
    wanted = table.where("doc_id IN (4, 5, 40)").select("class").distinct()
    found = search.sketches(wanted, 3)
    own = {r["class"]: (r.n, r.sketch[:3]) for r in table.where("n > 0").collect()}
    asked = {r["class"] for r in wanted.collect()}
    got = [(r["class"], (r.n, r.sketch)) for r in found.collect()]
    assert asked <= {c for c, _ in got} and len(got) == len(set(c for c, _ in got)) < 30  # a copy is told once
    assert all(own[c] == row for c, row in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1
    assert search.sketches(wanted.limit(0), 3).count() == 0
    bits = idfilter.bits_of(docs.where("doc_id = 4"), "doc_id")
    sets = neardup.full_sets(docs, 5, bits)
    assert sets._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one Python worker for each task
    assert [(r["class"], len(r.set)) for r in sets.collect()] == [(c, 8) for c in {r["class"] for r in table.where("doc_id = 4").collect()}]


def test_a_bitmap_of_few_ids_is_small(spark):
    docs, ids = spark.range(20_000).select(F.col("id").alias("doc_id")), spark.range(0, 20_000, 4)
    bits = idfilter.bits_of(ids, "id")
    assert len(bits.value) == idfilter.LEAST_BITS // 8  # the driver and every executor keep it on disk
    inside = {r.doc_id for r in idfilter.split(docs, F.col("doc_id"), bits, True).collect()}
    assert inside >= set(range(0, 20_000, 4)) and len(inside) < 5000 + 200
    full = np.random.default_rng(0).integers(0, 256, 1 << 20).astype(np.uint8)
    assert idfilter.halved(full, int(np.unpackbits(full).sum())) is full


def test_long_lists_are_cut_by_size_before_whole_sets_are_read(spark):
    marked = spark.createDataFrame([(7, c, 20 + c, 1, c) for c in range(400)], "value long, class long, n long, place int, label long")
    assert neardup.open_lists(marked).first().few > neardup.FEW
    for t in (0.5, 0.8, 0.85, 1.0):
        cut = neardup.bands(marked, t)
        pairs = lambda rows: {(r.a, r.b) for r in neardup.meeting(rows, neardup.open_lists(rows), t, 10).collect()}
        assert pairs(cut) == pairs(marked) == {(a, b) for a in range(400) for b in range(a + 1, 400) if 20 + a >= t * (20 + b) - 1e-9}
    # sets of few sizes in each band
    sparse = marked.where("class % 8 = 0").unionByName(marked.withColumn("n", F.col("n") * 40).withColumn("class", F.col("class") + 1000).withColumn("label", F.col("class")).where("class % 8 = 0"))
    assert neardup.open_lists(sparse).first().few > neardup.FEW
    assert neardup.open_lists(neardup.bands(sparse, 0.8)).where(F.col("few") > neardup.FEW).count() == 0


def test_bitmaps_are_deleted_when_their_rows_are_written(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(30 + i % 2))) for i in range(20)], "doc_id long, text string")
    table = shared.written(neardup.sketches(docs, 5), "test-sketch")
    search = neardup.Search(docs, table, 5, 80, 100)
    by_id = {r.doc_id: r["class"] for r in table.collect()}
    pairs = spark.createDataFrame([tuple(sorted((by_id[i], by_id[i + 1]))) for i in range(0, 20, 2)], "a long, b long")
    assert search.verified(pairs).count() == 10 and search.bitmaps == []
