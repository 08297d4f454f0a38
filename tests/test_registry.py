"""Versions under equal arrivals, and two writers on one registry."""

from pyspark.sql import functions as F

from varve.sources import registry as store

SCHEMA = "table_name string, arrival int, hash string, row_count bigint, snapshot_date string"


def batch(spark, *rows):
    return spark.createDataFrame([(t, a, h, 10, "2024-01-01") for t, a, h in rows], SCHEMA)


def test_equal_arrivals_get_distinct_gapless_versions(spark):
    got = store.classify(batch(spark, ("t", 1, "b"), ("t", 1, "a"), ("t", 1, "a"), ("t", 2, "c"), ("u", 1, "a")), store.empty(spark)).collect()
    assert sorted((r.table_name, r.hash, r.version, r.action) for r in got) == [
        ("t", "a", 1, "registered"), ("t", "a", 1, "unchanged"), ("t", "b", 2, "version_added"), ("t", "c", 3, "version_added"), ("u", "a", 1, "registered"),
    ]


def test_two_writers_and_a_retry(spark, tmp_path):
    log = store.RegistryLog(spark, str(tmp_path / "registry"))
    first, second = batch(spark, ("t", 1, "a"), ("t", 2, "b")), batch(spark, ("t", 1, "b"), ("t", 2, "c"), ("u", 1, "z"))
    # both start from the empty registry; the second to publish is refused and must look again
    number, state, _ = log.prepare(second, "2024-01-01")
    assert log.commit(first, "2024-01-01", "first").count() == 2
    assert log.publish(number, state, "second") is False
    actions = {(r.table_name, r.hash): (r.version, r.action) for r in log.commit(second, "2024-01-02", "second").collect()}
    assert actions == {("t", "b"): (2, "unchanged"), ("t", "c"): (3, "version_added"), ("u", "z"): (1, "registered")}
    assert log.commit(second, "2024-01-03", "second") is None
    number, registry = log.latest()
    assert number == 2
    assert sorted((r.table_name, r.version, r.hash) for r in registry.collect()) == [("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c"), ("u", 1, "z")]
    assert registry.where(F.col("hash") == "b").first().last_seen.day == 2
