"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm import ctw, decontaminate, fingerprints, language, licenses, mixing, neardup, quality, sharding, tokens

PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from here today"
LONG = " ".join(f"word{i % 9973} and{i}" for i in range(60_000))
ROWS = [
    (1, PLAIN, "en", "b"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, " \t\r\n ", "de", "a"),
    (5, LONG, "en", "a"),
    (6, "ein kleiner Text über Füße", "de", "a"),
    (6, "ein kleiner Text über Füße", "de", "a"),
    (None, PLAIN + " again", "en", "a"),
    (None, None, None, None),
    (7, PLAIN, "en", None),
    (8, "<|endoftext|>€ ௹ \U00010ec5 x", "en", "c"),
    (9, "12 34", "en", "c"),
]
CLASHING = "n size score label class value place key row bucket shard slot rate copy tail block tie print node a b id at turn word term item_id threshold _x".split()
LABELS = [(1, 1, 0), (5, 1, 0), (4, 0, 0), (9, 0, 0), (None, 1, 1), (7, None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string"
    frame = spark.createDataFrame(ROWS, schema)
    return frame.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PLAIN), (2, None), (3, ""), (None, PLAIN), (4, "one two three"), (1, PLAIN)], "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality(docs, nothing, labels, spark):
    out = quality.quality_scores(docs, labels, steps=20)
    assert out.count() == len(ROWS)
    found = {r.doc_id: r for r in out.collect()}
    assert found[None].held_out is None
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.collect())
    same = {r.score for r in out.where("doc_id IN (1, 7)").collect()}
    assert len(same) == 1
    assert quality.quality_scores(nothing, labels, steps=5).count() == 0
    even = quality.quality_scores(docs, labels.limit(0), steps=5)
    assert {r.score for r in even.collect()} == {0.5}
    kept = quality.keep_good(docs, labels, steps=20)
    assert kept.columns == docs.columns


def test_tokens(docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False)), len(library.encode(t or "", add_special_tokens=False)) > 512) for d, t, *_ in ROWS), key=repr)
    assert rows(tokens.token_counts(docs, path)) == want
    assert tokens.token_counts(nothing, path).count() == 0


def test_mixing(docs, nothing):
    out = mixing.mix_counts(docs)
    assert out.count() == len(ROWS)
    assert all(r.taken <= 2 * r.size for r in out.collect())
    assert {r.taken for r in out.where("size = 0").collect()} == {0}
    assert mixing.mix_counts(nothing).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(nothing).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.target, r.taken) for r in mixing.mix_counts(blank).collect()} == {(0.0, 0)}


def test_context_tree(docs, nothing):
    out = ctw.scores(docs, max_nodes=50_000, max_words=1000)
    assert out.count() == len(ROWS)
    assert all(r.score <= 0 and r.n_known <= r.n_tokens for r in out.collect())
    assert {r.n_tokens for r in out.where("doc_id IN (2, 3, 4)").collect()} == {1}
    assert ctw.scores(nothing).count() == 0


def test_decontamination(docs, nothing, items, spark):
    out = decontaminate.contaminated(docs, items)
    assert sorted((r.doc_id or 0, r.item_id) for r in out.collect()) == [(0, 1), (1, 1), (7, 1)]
    # the same with an index in several blocks
    assert rows(decontaminate.contaminated(docs, items, block_words=8)) == rows(out)
    assert decontaminate.contaminated(nothing, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3


def test_decontamination_by_items_that_share_an_id_or_have_none(spark):
    texts = ["red apples grow on old trees near the river every year", "cold winds blow over the northern hills at night in winter", "seven ships sailed slowly towards the distant harbour of gold today"]
    docs = spark.createDataFrame([(k, f"see here {t} and so on") for k, t in enumerate(texts)] + [(9, "none of these at all")], "doc_id long, text string")
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (1, texts[0]), (None, texts[0])], "item_id long, text string")
    for words in (2_000_000, 8):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, block_words=words).collect()) == [(0, 1), (1, 1), (2, None)]
        assert [r.doc_id for r in decontaminate.keep_clean(docs, items, block_words=words).collect()] == [9]


def test_near_duplicates(docs, nothing):
    out = {(r.doc_id, r.n_shingles): r for r in neardup.near_duplicates(docs, 3, 85, 100).collect()}
    assert out[7, 14].component_id == 1 and not out[7, 14].kept and out[1, 14].kept
    assert all(out[k].component_id == k[0] for k in out if k[0] in (2, 3, 4, 5, 6, 8, 9))
    assert out[2, 0].kept and out[9, 1].kept
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    # 7 repeats 1, the row without id is near to both, 6 comes twice
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert neardup.keep_one(nothing).count() == 0


def test_sharding(docs, nothing):
    out = sharding.shard_digest(docs, shards=3)
    got = out.collect()
    sizes = [sum(r.shard == s for r in got) for s in range(3)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(3) for k in range(sizes[s])]
    assert rows(sharding.shard_digest(docs.repartition(5), shards=3)) == rows(out)
    assert sharding.shard_digest(nothing).count() == 0
    assert set(sharding.shuffle_to_shards(docs).columns) == set(docs.columns)


def test_licenses(docs, nothing):
    assert licenses.license_matches(docs).count() == 0
    assert licenses.license_matches(nothing).count() == 0
    assert licenses.license_matches(docs, {}).count() == 0
    assert [tuple(r)[:2] for r in licenses.license_matches(docs, {"fox": "quick brown fox jumps over"}).orderBy("doc_id").collect()] == [(None, "fox"), (1, "fox"), (7, "fox")]


def test_fingerprints(docs, nothing):
    out = fingerprints.compare_with_edits(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS)
    assert got[1].fingerprint == got[7].fingerprint
    assert got[2].n_chars == 0 and got[2].fingerprint == "" and got[2].near_next == 1.0
    assert fingerprints.compare_with_edits(nothing).count() == 0
    alone = fingerprints.compare_with_edits(docs.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_language(docs, nothing):
    out = {r.doc_id: r for r in language.languages(docs).collect()}
    assert out[2].lang_pred == out[3].lang_pred == out[4].lang_pred == out[9].lang_pred == "und"
    assert out[6].lang_pred in ("de", "en") and 0 < out[6].score <= 1
    assert language.languages(nothing).count() == 0
    untaught = language.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_schemas_are_stable(docs, nothing):
    assert neardup.near_duplicates(nothing).schema == neardup.near_duplicates(docs).schema
    assert isinstance(mixing.mix_counts(nothing).schema["target"].dataType, T.DoubleType)
