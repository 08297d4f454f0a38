"""Row plane: exact quartiles, moments, distinct values and the shape of the plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.operators import exact, pairs
from varve.plans import tables
from varve.plans.workspace import Workspace
from varve.sources import rows
from conftest import SF_DIR


def profile_of(spark, df, **kw):
    return rows.profile(spark, [rows.TableSpec("t", df, **kw)]).toPandas().set_index(["version", "column_name"])


@pytest.mark.parametrize("kind", ["uniform", "lognormal", "ties", "cluster", "wide", "tiny"])
def test_quartiles_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    n = 3 if kind == "tiny" else 4001
    values = {
        "uniform": rng.uniform(-5, 5, n),
        "lognormal": rng.lognormal(3, 4, n),
        "ties": rng.integers(0, 4, n).astype(float),
        "cluster": np.r_[1 + rng.uniform(0, 1e-7, n - 1), 1e12],
        "wide": rng.choice([-1e300, -1.0, 0.0, 1e-300, 1e300], n),
        "tiny": np.array([3.0, 1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"version": 1, "x": values}))
    row = profile_of(spark, df).loc[(1, "x")]
    for name, p in [("q25", 25), ("q50", 50), ("q75", 75)]:
        assert row[name] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-300)
    assert row["cardinality_count"] == len(np.unique(values))


def test_hot_group_and_missing_values(spark):
    x = pd.Series([1.0] * 700 + [None] * 200 + list(range(100)))
    t = pd.Series(["a"] * 900 + [""] * 50 + ["b" * 200] * 50)
    row = profile_of(spark, spark.createDataFrame(pd.DataFrame({"version": 1, "x": x, "t": t})))
    assert row.loc[(1, "x"), "missing_count"] == 200
    assert row.loc[(1, "x"), "mode"] == "1.0"
    assert row.loc[(1, "t"), "blank_value_count"] == 50
    assert row.loc[(1, "t"), "chars_max_count"] == 200
    assert row.loc[(1, "t"), "most_common_value"] == "a"


def test_long_texts_are_answered_as_they_are(spark):
    t = ["z" * 90] * 3 + ["b" * 70] + ["c"] * 2
    row = profile_of(spark, spark.createDataFrame(pd.DataFrame({"version": 1, "t": t}))).loc[(1, "t")]
    assert row["mode"] == "z" * 90 and row["least_common_value"] == "b" * 70


def test_rows_without_a_version_keep_every_statistic(spark):
    x = [float(i % 17) for i in range(400)] + [900.0]
    data = [(v, a, "word " * 9 + str(i % 5)) for v in (None, 1, 2) for i, a in enumerate(x)]
    spec = rows.TableSpec("t", spark.createDataFrame(data, "version int, x double, t string"))
    for mode in ("exact", "sketch"):
        profile = rows.profile(spark, [spec], mode=mode)
        facts = {(r.version, r.column_name): r.asDict() for r in profile.collect()}
        for column in ("x", "t"):
            one, none = facts[1, column], facts[None, column]
            assert none["abt_name"] == "t_vnone"
            assert {k: v for k, v in none.items() if k not in ("version", "abt_name")} == {k: v for k, v in one.items() if k not in ("version", "abt_name")}
            assert none["mode"] is not None and (column == "t" or none["q50"] is not None and none["n_outliers"] == 1 and none["skewness"] > 0)
        ws = Workspace(profile)
        assert {r.version for r in pairs.versions(profile).collect()} == {1, 2}
        assert [tuple(r) for r in pairs.unversioned(profile).collect()] == [("t", 2, 401, 0)]
        assert {r.version for r in ws.s0.select("version").collect()} == {None, 1, 2}
        assert {r.version for r in ws.i2.select("version").collect()} == {None, 1, 2}
        assert {r.present for r in pairs.grid(ws.scored).collect()} == {True}


def test_texts_travel_as_digests_and_extremes_come_back_whole(spark):
    same = "sixteen characters and then "
    t = [same + "zz"] * 3 + [same + "ab"] * 3 + [same + "c", "short", "short"] + [same[:16], "tiny"]
    spec = rows.TableSpec("t", spark.createDataFrame([(1, x) for x in t], "version int, t string"))
    counts = rows.written_counts([spec])
    assert "txt" not in counts.columns and {len(r.digest) for r in counts.collect()} == {16} and max(len(r.head) for r in counts.collect()) == 16
    row = rows.profile(spark, [spec], counts=counts).first()
    assert row["mode"] == same + "ab" and row["least_common_value"] == same[:16]
    assert row["cardinality_count"] == 6


def test_sketch_mode_finds_frequent_values_and_says_when_there_are_none(spark):
    data = [(1, "often" if i % 50 == 0 else f"id{i}", i % 300 if i % 3 else 7, f"u{i}", i % 9) for i in range(20_000)]
    spec = rows.TableSpec("t", spark.createDataFrame(data, "version int, often string, n int, unique string, few int"))
    got = {r.column_name: r for r in rows.sketch_facts([spec])[1].collect()}
    assert (got["often"].most_common_value, got["often"].mode_count, got["often"].least_common_value) == ("often", 400, None)
    assert (got["n"].most_common_value, got["n"].mode_count) == ("7.0", sum(1 for r in data if r[2] == 7))
    assert got["unique"].most_common_value is None and got["unique"].least_common_value is None
    assert got["few"].most_common_value == "0.0" and got["few"].mode_count == 2223 and got["few"].least_common_value == "2.0"


def test_declared_types_and_patterns_from_a_rules_table(spark):
    df = spark.createDataFrame([(1, "12", "2024-01-05", "A1"), (1, "x", "2024-13-05", "b2"), (1, " ", None, ""), (1, None, "soon", "C3")], "version int, n string, d string, code string")
    rules = spark.createDataFrame([("t", "n", "int", None), ("t", "d", "date", None), ("t", "code", None, "^[A-Z][0-9]$"), ("u", "n", "int", None)], rows.RULE_SCHEMA)
    for mode in ("exact", "sketch"):
        got = {r.column_name: r.mismatched_count for r in rows.profile(spark, rows.with_rules([rows.TableSpec("t", df)], rules), mode=mode).collect()}
        assert got == {"n": 1, "d": 2, "code": 1}


def test_moments_match_pandas(spark):
    v = np.random.default_rng(3).gamma(2.0, 2.0, 2000) + 1e6
    row = profile_of(spark, spark.createDataFrame(pd.DataFrame({"version": 1, "x": v}))).loc[(1, "x")]
    d = v - v.mean()
    assert row["std"] == pytest.approx(v.std(ddof=1), rel=1e-9)
    assert row["skewness"] == pytest.approx((d**3).mean() / v.std() ** 3, rel=1e-6)
    assert row["kurtosis"] == pytest.approx((d**4).mean() / v.std() ** 4 - 3, rel=1e-6)


def test_large_integers_stay_distinct(spark):
    df = spark.range(1000).select(F.lit(1).alias("version"), (F.col("id") + 2**60).alias("x"))
    row = profile_of(spark, df).loc[(1, "x")]
    assert row["cardinality_count"] == 1000 and row["statistical_scale"] == "id"


def test_all_null_column_and_patterns_on_whole_texts(spark):
    long_bad = "1" * 100 + "x"
    pdf = pd.DataFrame({"version": 1, "t": ["12", "x", long_bad, " " * 90], "n": pd.Series([None] * 4, dtype="float64")})
    df = spark.createDataFrame(pdf)
    row = profile_of(spark, df, patterns={"t": "^[0-9]+$"})
    assert row.loc[(1, "t"), "mismatched_count"] == 2
    assert row.loc[(1, "t"), "blank_value_count"] == 1
    assert row.loc[(1, "n"), "completeness_percent"] == 0 and row.loc[(1, "n"), "cardinality_count"] == 0


def test_nested_columns_have_a_completeness_only(spark):
    df = spark.range(40).select(F.lit(1).alias("version"), F.when(F.col("id") % 4 > 0, F.array("id")).alias("list"), F.col("id").cast("string").cast("binary").alias("raw"))
    for mode in ("exact", "sketch"):
        profile = rows.profile(spark, [rows.TableSpec("t", df)], mode=mode)
        row = {r["column_name"]: r for r in profile.collect()}
        assert row["list"]["completeness_percent"] == 75 and row["list"]["cardinality_count"] is None
        assert {r["statistical_scale"] for r in row.values()} == {"nested"}
        assert {r["rule"] for r in Workspace(profile).s2.collect()} == set()


def test_sketch_agrees_with_exact(spark):
    df = spark.range(20000).select((F.col("id") % 2).cast("int").alias("version"), (F.col("id") * 7 % 9973).cast("double").alias("x"))
    spec = [rows.TableSpec("t", df)]
    a = rows.profile(spark, spec).toPandas().sort_values("version")
    b = rows.profile(spark, spec, mode="sketch").toPandas().sort_values("version")
    assert np.allclose(a[["mean", "std", "min_val", "max_val"]], b[["mean", "std", "min_val", "max_val"]])
    assert np.allclose(a[["q25", "q50", "q75"]], b[["q25", "q50", "q75"]], rtol=0.01)
    assert np.allclose(a["cardinality_count"], b["cardinality_count"], rtol=0.05)


def test_order_of_rows_does_not_matter(spark):
    df = tables.orders_table(spark, SF_DIR)
    cols = ["version", "column_name", "q25", "q50", "q75", "cardinality_count", "mode"]
    a = rows.profile(spark, [rows.TableSpec("t", df)]).select(*cols).toPandas()
    b = rows.profile(spark, [rows.TableSpec("t", df.repartition(5).orderBy(F.rand(1)))]).select(*cols).toPandas()
    key = ["version", "column_name"]
    pd.testing.assert_frame_equal(a.sort_values(key, ignore_index=True), b.sort_values(key, ignore_index=True))


def test_melt_scans_the_source_once_and_stays_in_the_jvm(spark):
    long = rows.value_counts(rows.melt(tables.specs(spark, SF_DIR)[2]))
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "props" in plan and "ReadSchema" in plan


def exact_inputs(spark, df):
    spec = rows.TableSpec("t", df)
    counts = rows.written_counts([spec])
    ws = Workspace(rows.profile(spark, [spec], counts=counts))
    return counts, ws.metrics, exact.pair_counts(counts, exact.compared(ws.metrics))


def test_a_replaced_vocabulary_is_a_shift_however_many_words(spark, monkeypatch):
    monkeypatch.setattr(exact, "FLOOR", 0.01)  # stands for more categories than one over the floor
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("version"), F.concat((F.col("id") % 2).cast("string"), F.lit("-"), (F.col("id") % 800).cast("string")).alias("word"))
    _, metrics, pc = exact_inputs(spark, df)
    row = exact.psi_categorical_exact(pc, metrics).first()
    assert row["psi_label"] == "shift" and row["psi"] > 1 and row["categories"] == 800


def test_ks_ranges_stay_even_beside_a_sentinel(spark):
    rng = np.random.default_rng(5)
    n = 6000
    values = np.r_[np.zeros(400), rng.integers(1_700_000_000, 1_730_000_000, n - 400)].astype(float)
    version = rng.integers(0, 2, n)
    values[version == 1] += np.where(values[version == 1] > 0, 500_000, 0)
    counts, metrics, pc = exact_inputs(spark, spark.createDataFrame(pd.DataFrame({"version": version, "x": values})))
    got = exact.ks_exact(pc, metrics).first()["ks"]
    a, b = np.sort(values[version == 0]), np.sort(values[version == 1])
    at = np.unique(values)
    want = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
    assert got == pytest.approx(want)
    sizes = [r["count"] for r in exact.ranged(pc.where("num is not null")).groupBy("range").count().collect()]
    assert max(sizes) < 3 * len(at) / exact.RANGES


@pytest.fixture
def small_broadcasts(spark):
    """The limit at which the test tables show the plans of large ones."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(200 << 10))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def initial_plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def test_statistics_are_broadcast_against_rows_and_value_counts(spark, small_broadcasts):
    sf = SF_DIR.replace("0.001", "0.01")
    events = tables.specs(spark, sf)[2]
    _, facts = rows.sketch_facts([events])
    assert "SortMergeJoin" not in initial_plan(facts) and "BroadcastHashJoin" in initial_plan(facts)
    counts = rows.written_counts([events])
    stats = rows.written(rows.basic_facts(counts), "facts")
    quartiles = rows.written(rows.exact_quartiles(counts, stats), "quartiles")
    assert "SortMergeJoin" not in initial_plan(rows.frequency_extremes(counts, stats, [events]).select("low_num")).split("Join")[-1]
    facts = initial_plan(rows.value_facts(counts, stats, quartiles, [events]))
    assert facts.count("BroadcastHashJoin") >= 3


def test_alerts_reach_the_last_day_of_every_column(spark):
    from pyspark.sql import functions as F

    from varve.plans.registry import QUERIES

    days = {r.day for r in spark.read.parquet(f"{SF_DIR}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().collect()}
    got = [(r.window_start, r.column_name) for r in QUERIES["M2_drift_alerts"](spark, SF_DIR).collect()]
    assert sorted(got) == sorted((d, c) for d in days for c in ("event_id", "user_id", "value", "event_type", "props"))


def test_tables_are_counted_as_their_long_form(spark):
    """Narrow counts of every kind of column, under group numbers, have the rows that the long form gives."""
    long_text = "sixteen letters and more "
    data = spark.sql(f"""
        SELECT CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN -7 WHEN id % 5 = 2 THEN 2147483647 ELSE 3 END AS version,
          id % 2 = 0 AS flag, CAST(id % 3 AS tinyint) AS tiny, id % 4 + 9007199254740992 AS large,
          CASE id % 6 WHEN 0 THEN double('NaN') WHEN 1 THEN -0.0D WHEN 2 THEN 0.0D WHEN 3 THEN double('Infinity') WHEN 4 THEN NULL ELSE 1.5D END AS real,
          CAST(id % 3 AS float) AS single, CAST(id AS decimal(9, 2)) AS small_decimal, CAST(id % 7 AS decimal(30, 3)) / 1000 + 123456789012345678 AS decimal,
          date_add(DATE'2024-01-01', int(id % 4)) AS day, timestamp_micros(id % 9) AS ts, timestamp_ntz'2024-01-01 00:00:00' AS ntz,
          CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN '12' WHEN 2 THEN 'x1' WHEN 3 THEN NULL WHEN 4 THEN repeat(' ', 20) WHEN 5 THEN concat('{long_text}', id % 2) ELSE repeat('7', 17) END AS words,
          CASE WHEN id % 3 > 0 THEN array(id) END AS list, CAST('a' AS binary) AS raw, int(NULL) AS nothing
        FROM range(400)""")
    one = rows.TableSpec("one", data, present={"flag": F.col("version") > 0}, patterns={"words": "^[0-9]+$"}, types={"words": "int"})
    two = rows.TableSpec("two", data.select("version", "words", "large"))
    counts = rows.written_counts([one, two])
    plain = rows.versioned(rows.value_counts(rows.melt_all([one, two])))
    assert plain.exceptAll(counts.drop("g")).isEmpty() and counts.drop("g").exceptAll(plain).isEmpty()
    pair = {r.g: (r.table_name, r.version, r.column_name) for r in counts.select("g", *rows.KEYS).distinct().collect()}
    assert len(set(pair.values())) == len(pair) == counts.select("g").distinct().count()
    assert {v for _, v, _ in pair.values()} == {rows.NO_VERSION, -7, 3, 2147483647}


def test_value_counts_stay_in_place(spark, small_broadcasts):
    """Passes over the value counts join by the group's number, and no pass but the first shuffles them."""
    events = tables.specs(spark, SF_DIR.replace("0.001", "0.01"))[2]
    counts = rows.written_counts([events])
    stats = rows.written(rows.basic_facts(counts), "facts")
    quartiles = rows.written(rows.exact_quartiles(counts, stats), "quartiles")
    plan = initial_plan(rows.value_facts(counts, stats, quartiles, [events]))
    assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and "Inner" in line]
    counting = initial_plan(rows.table_counts([events]))
    shuffled = [line for line in counting.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 4 and not any("column_name" in line or "table_name" in line for line in shuffled)
