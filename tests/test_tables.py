"""The test tables and their value counts: joins done once, digests taken per value."""

from pyspark.sql import functions as F

from varve.plans import tables
from varve.sources import rows
from conftest import SF_DIR


def test_orders_are_joined_once_and_written(spark):
    tables.forget()
    mutated, steady = tables.specs(spark, SF_DIR)[:2]
    for spec in (mutated, steady):
        plan = spec.rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    same = tables.specs(spark, SF_DIR)[1].rows
    assert same.inputFiles() == steady.rows.inputFiles()
    tables.forget()
    assert tables.specs(spark, SF_DIR)[1].rows.inputFiles() != steady.rows.inputFiles()
    joined = tables.orders_table(spark, SF_DIR)
    assert steady.rows.exceptAll(joined).isEmpty() and joined.exceptAll(steady.rows).isEmpty()


def test_digests_of_short_texts_are_taken_after_counting(spark):
    head = "sixteen letters!"
    texts = [head, head, head + "a", head + "b", head + "b", "short", "", None]
    spec = rows.TableSpec("t", spark.createDataFrame([(1, t) for t in texts], "version int, t string"))
    counts = rows.value_counts(rows.melt(spec))
    got = {(bytes(r.digest) if r.digest is not None else None): (r.cnt, r.len, r.head) for r in counts.collect()}
    per_text = spark.createDataFrame([(t,) for t in texts], "t string").groupBy("t").count()
    want = {(bytes(r.d) if r.d is not None else None): (r["count"], None if r.t is None else len(r.t), None if r.t is None else r.t[:16]) for r in per_text.withColumn("d", rows.digest(F.col("t"))).collect()}
    assert got == want and len(got) == 6
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate" in line and "md5" in line for line in plan.splitlines())
