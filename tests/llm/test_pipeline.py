"""Each stage of the pipeline on all that the one before kept, against a plain version of its decision."""

from collections import Counter

import corpus_pipeline
import pytest
from conftest import SF_DIR
from test_methods import groups, shingles

from varve.llm import quality, queries
from varve.sources.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.documents(spark, SF_DIR)
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs = written(stage(spark, docs, SF_DIR), name)
    return kept


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_columns(stages):
    assert all(df.columns == COLUMNS for name, df in stages.items() if name != "sharding")
    assert stages["sharding"].columns == [*COLUMNS, "shard", "slot"]


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = quality.quality_scores(stages["documents"], labels).collect()
    assert ids(stages["quality"]) == sorted(r.doc_id for r in scored if r.predicted == 1)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & set(ids(stages["quality"]))) >= 0.95 * len(good)


def test_near_duplicates(stages):
    component, _ = groups([(r.doc_id, r.text) for r in stages["quality"].collect()], 5, 80, 100)
    assert ids(stages["near_duplicates"]) == sorted(i for i, c in component.items() if c == i)


def test_decontamination(spark, stages):
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in stages["near_duplicates"].collect() if any(len(i & shingles(r.text, 5)) >= 0.5 * len(i) for i in items)}
    assert set(ids(stages["decontamination"])) == set(ids(stages["near_duplicates"])) - dirty


def test_mixing(stages):
    copies = Counter(ids(stages["mixing"]))
    assert set(copies) <= set(ids(stages["decontamination"])) and set(copies.values()) <= {1, 2}


def test_sharding_and_run(spark, stages):
    assert ids(stages["sharding"]) == ids(stages["mixing"])
    again = corpus_pipeline.run(spark, SF_DIR)
    place = lambda df: sorted((r.shard, r.slot, r.doc_id) for r in df.collect())
    assert place(again) == place(stages["sharding"])
    assert len({p[:2] for p in place(again)}) == again.count()
