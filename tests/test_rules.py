"""Profile plane: hand-worked edges of rules, scores, patterns, indexes and ladders."""

import json

import pytest
from pyspark.sql import functions as F

from varve.config import Thresholds
from varve.operators import cards, compare, drift, pairs, single
from varve.plans.workspace import Workspace, run_analysis, run_comparison
from varve.sources import payloads, registry


def column(df, name, key="column_name"):
    return {r[key]: r[name] for r in df.collect()}


# ── sample document, worked by hand ─────────────────────────────────────────────────────────────

SAMPLE = {
    "abt_snapshot": {"name": "parcels_v1", "row_count": 800, "snapshot_date": "2023-05-01"},
    "items": [
        {"name": "parcel_no", "attributes": {"dataType": "num", "statisticalScale": "id", "ordinalPosition": 1, "completenessPercent": 100, "cardinalityCount": 800, "uniquenessPercent": 100, "hasUniqueField": True}},
        {"name": "weight", "attributes": {"dataType": "num", "statisticalScale": "interval", "ordinalPosition": 2, "completenessPercent": 100, "cardinalityCount": 120, "uniquenessPercent": 15, "mean": 3.1, "median": 3.0, "standardDeviation": 1.2, "min": 0.2, "max": 7.5, "skewness": 0.2, "quantiles25": 2.1, "quantiles50": 3.0, "quantiles75": 3.9, "informationPrivacy": "private"}},
        {"name": "distance", "attributes": {"dataType": "num", "statisticalScale": "interval", "ordinalPosition": 3, "completenessPercent": 90, "missingCount": 80, "cardinalityCount": 160, "uniquenessPercent": 20, "mean": 310, "median": 280, "standardDeviation": 140, "min": 5, "max": 900, "skewness": 0.7, "quantiles25": 190, "quantiles50": 280, "quantiles75": 410, "hasOutliers": True, "nOutliers": 9}},
        {"name": "target", "attributes": {"dataType": "num", "statisticalScale": "binary", "ordinalPosition": 4, "completenessPercent": 100, "cardinalityCount": 2, "uniquenessPercent": 0.25, "mean": 0.2, "standardDeviation": 0.4, "min": 0, "max": 1, "skewness": 1.5}},
    ],
}


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.createDataFrame([("loans", 1, json.dumps(SAMPLE))], "table_name string, version int, payload string")
    return run_analysis(payloads.profiles(payloads.documents(df)))


def test_sample_scores(sample):
    assert column(sample["s8"], "score") == {"parcel_no": 71.0, "weight": 88.3, "distance": 87.3, "target": 100.0}
    s0 = sample["s0"].first()
    assert (s0["score"], s0["readiness_label"], s0["caution_cols"], s0["target_cols"]) == (82.2, "ready", 3, 1)


def test_sample_sections(sample):
    s1 = sample["s1"].first()
    assert (s1["total_columns"], s1["fully_complete"], s1["privacy_flagged"], s1["overall_health"]) == (4, 3, 1, "caution")
    assert sample["s2"].count() == 0
    assert column(sample["s3"], "issue") == {"distance": "partial_missing"}
    assert column(sample["s4"], "risk_type") == {"parcel_no": "IDENTIFIER", "weight": "PRIVACY"}
    assert column(sample["s5"], "status") == {"parcel_no": "caution", "weight": "caution", "distance": "caution", "target": "ready"}
    s6 = sample["s6"].first()
    assert (s6["event_rate"], s6["imbalance_ratio"], s6["balance_label"]) == (20.0, 4.0, "severe")
    assert column(sample["s7"], "skew_label") == {"weight": "symmetric", "distance": "mild skew"}
    assert [r["priority_score"] for r in sample["s9"].orderBy("action_rank").collect()] == [27, 18, 10]
    assert column(sample["i1"], "verdict") == {"parcel_no": "drop", "weight": "exclude", "distance": "fix_then_use", "target": "use"}
    steps = {r["column_name"]: [s["method"] for s in r["steps"]] for r in sample["i1"].collect()}
    assert steps["distance"] == ["median", "winsorise"]


# ── payload forms and the registry ──────────────────────────────────────────────────────────────


@pytest.mark.parametrize(
    "text",
    [
        json.dumps(SAMPLE),
        json.dumps(json.dumps(SAMPLE)),
        json.dumps(SAMPLE["items"]),
        "payload: " + json.dumps(SAMPLE) + " end",
        json.dumps({"count": 4, "items": [{"name": i["name"], **i["attributes"]} for i in SAMPLE["items"]]}),
    ],
)
def test_accepted_forms(spark, text):
    df = spark.createDataFrame([("t", 1, text)], "table_name string, version int, payload string")
    out = payloads.profiles(payloads.documents(df))
    assert column(out, "cardinality_count") == {"parcel_no": 800, "weight": 120, "distance": 160, "target": 2}


def test_defaults_and_bad_numbers(spark):
    text = json.dumps([{"name": "a", "attributes": {"mean": "abc", "std": 1, "completenessPercent": None, "hasOutliers": "false", "min": "NaN"}}])
    df = spark.createDataFrame([("t", 1, text), ("u", 1, "not json")], "table_name string, version int, payload string")
    docs = payloads.documents(df)
    row = payloads.profiles(docs).first()
    assert (row["mean"], row["min_val"], row["completeness_percent"], row["has_outliers"]) == (None, None, 100.0, False)
    assert (row["cardinality_count"], row["row_count"], row["row_count_measured"]) == (0, 1, False)
    assert [r["table_name"] for r in payloads.unreadable(docs).collect()] == ["u"]


def test_hash_ignores_order_and_volatile_keys(spark):
    a = [{"name": "x", "attributes": {"mean": 1, "min": 0}, "id": 1}, {"name": "y", "attributes": {"mean": 2}}]
    b = [{"attributes": {"mean": 2}, "name": "y"}, {"name": "x", "id": 9, "attributes": {"min": 0, "mean": 1}}]
    c = [{"name": "x", "attributes": {"mean": 1, "min": 5}}, {"name": "y", "attributes": {"mean": 2}}]
    df = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate([a, b, c])], "table_name string, payload string")
    h = column(payloads.content_hash(payloads.documents(df)), "hash", "table_name")
    assert h["0"] == h["1"] != h["2"]


def test_registry_versions(spark):
    schema = "table_name string, hash string, arrival int, row_count bigint, snapshot_date string"
    first = spark.createDataFrame([("t", "h1", 1, 10, "d"), ("t", "h1", 2, 10, "d"), ("t", "h2", 3, 11, "d")], schema)
    reg = registry.ingest(registry.empty(spark), registry.classify(first, registry.empty(spark)), "2024-01-01")
    assert sorted((r["version"], r["hash"]) for r in reg.collect()) == [(1, "h1"), (2, "h2")]
    second = spark.createDataFrame([("t", "h1", 1, 10, "d"), ("t", "h3", 2, 12, "d"), ("u", "h9", 1, 1, "d")], schema)
    got = registry.classify(second, reg)
    assert {(r["table_name"], r["hash"]): (r["version"], r["action"]) for r in got.collect()} == {
        ("t", "h1"): (1, "unchanged"), ("t", "h3"): (3, "version_added"), ("u", "h9"): (1, "registered"),
    }
    after = registry.ingest(reg, got, "2024-02-01")
    seen = {(r["table_name"], r["version"]): str(r["last_seen"])[:10] for r in after.collect()}
    assert seen[("t", 1)] == "2024-02-01" and seen[("t", 2)] == "2024-01-01"


# ── edges ───────────────────────────────────────────────────────────────────────────────────────


def test_blocker_edges(make_profile):
    p = make_profile(
        {"column_name": "half", "completeness_percent": 50.0},
        {"column_name": "under", "completeness_percent": 49.99},
        {"column_name": "mm_at", "mismatched_count": 150},
        {"column_name": "mm_over", "mismatched_count": 151},
        {"column_name": "one", "cardinality_count": 1},
        {"column_name": "unary", "statistical_scale": "unary"},
    )
    got = column(single.blockers(single.scored(p)), "rule")
    assert got == {"under": "high_missing", "mm_over": "severe_mismatch", "one": "zero_variance", "unary": "zero_variance"}


def test_leakage_edges(make_profile):
    unit = {"min_val": 0.0, "max_val": 1.0}
    p = make_profile(
        {"column_name": "score", "cardinality_count": 50, **unit},
        {"column_name": "few", "cardinality_count": 49, **unit},
        {"column_name": "Target", "cardinality_count": 50, **unit},
        {"column_name": "uniq", "uniqueness_percent": 99.9},
    )
    assert column(single.governance(single.scored(p)), "risk_type") == {"score": "LEAKAGE", "uniq": "IDENTIFIER"}


@pytest.mark.parametrize(
    "series, want",
    [
        ([100, 100], "complete"), ([40, 30], "sparse"), ([100, 99], "newly_missing"), ([80, 86], "recovering"),
        ([90, 84], "growing_missing"), ([90, 95], "stable_missing"), ([98, 100], "stable_missing"), ([None, None], "absent"),
    ],
)
def test_missing_pattern(spark, series, want):
    first, last = series
    known = [v for v in series if v is not None]
    row = spark.createDataFrame([(float(first) if first is not None else None, float(last) if last is not None else None, float(min(known)) if known else None, float(max(known)) if known else None)], "f double, l double, lo double, hi double")
    assert row.select(compare.missing_pattern(F.col("f"), F.col("l"), F.col("lo"), F.col("hi"))).first()[0] == want


def metrics_of(make_profile, *rows):
    return drift.pair_metrics(pairs.consecutive(pairs.grid(single.scored(make_profile(*rows)))))


def test_identical_versions_are_stable(make_profile):
    m = metrics_of(make_profile, {"version": 1}, {"version": 2}).first()
    assert (m["psi"], m["psi_label"], m["ks"], m["std_change"], m["cv_change"]) == (0.0, "stable", 0.0, 0.0, 0.0)


def test_absent_and_degenerate_pairs(make_profile):
    m = metrics_of(
        make_profile,
        {"version": 1, "column_name": "gone"},
        {"version": 1, "column_name": "flat", "std": 0.0, "mean": 0.0},
        {"version": 2, "column_name": "flat", "std": 1.0, "mean": 5.0},
        {"version": 1, "column_name": "noq", "q25": None, "q50": None, "q75": None},
        {"version": 2, "column_name": "noq"},
        {"version": 2, "column_name": "fresh"},
    )
    label = column(m, "psi_label")
    assert label["gone"] == label["fresh"] == "absent" and label["noq"] == "insufficient_data"
    flat = m.where("column_name = 'flat'").first()
    assert flat["cv_change"] is None and flat["std_change"] is None


def test_categorical_proxy_caps(make_profile):
    c = {"data_type": "char", "statistical_scale": "nominal", "q25": None, "q50": None, "q75": None}
    m = metrics_of(
        make_profile,
        {"version": 1, "column_name": "a", "cardinality_count": 5, **c}, {"version": 2, "column_name": "a", "cardinality_count": 6, **c},
        {"version": 1, "column_name": "b", "cardinality_count": 5, **c}, {"version": 2, "column_name": "b", "cardinality_count": 50, **c},
        {"version": 1, "column_name": "c", "cardinality_count": 5, **c}, {"version": 2, "column_name": "c", "cardinality_count": 5, **c},
    )
    assert column(m, "psi") == {"a": 0.15, "b": 1.0, "c": 0.0}
    assert column(m, "psi_label") == {"a": "monitor", "b": "shift", "c": "stable"}


def test_cardinality_events(make_profile):
    c = {"data_type": "char", "statistical_scale": "nominal"}
    m = metrics_of(
        make_profile,
        *[{"version": v, "column_name": n, "cardinality_count": k, **c} for n, ks in
          {"grow": (10, 15), "some": (10, 12), "same": (10, 11)}.items() for v, k in zip((1, 2), ks)],
        {"version": 1, "column_name": "lost", **c},
    )
    assert column(compare.cardinality_drift(m), "severity") == {"grow": "critical", "some": "notable", "lost": "dropped"}


def test_steady_table_is_clear(make_profile):
    got = run_comparison(make_profile(*[{"version": v, "column_name": n} for v in (1, 2, 3) for n in ("x", "z")]))
    assert got["c0"].first()["verdict"] == "CLEAR"
    assert (got["i7"].first()["decision"], got["i7"].first()["urgency"]) == ("hold", "none")
    assert got["fallback_cards"].first()["source"] == "c0_clear"
    assert got["cards"].where("not validation_passed").count() == 1  # governance card without sign-off wording
    assert got["signals"].count() == 0


def test_block_verdict_holds_model_actions(make_profile):
    bad = {"completeness_percent": 10.0}
    got = run_comparison(make_profile(*[{"version": v, "column_name": n, **(bad if v == 2 else {})} for v in (1, 2) for n in ("x", "z")]))
    assert got["c0"].first()["verdict"] == "BLOCK"
    assert got["i7"].first()["urgency"] == "pipeline_fix_first"
    ranks = [r["final_rank"] for r in got["cards"].collect()]
    assert max(ranks) == 1


def test_single_version_compares_to_nothing(make_profile):
    ws = Workspace(make_profile({"version": 1}))
    assert ws.c1.count() == 0 and ws.c0.first()["verdict"] == "CLEAR"


def test_action_words(spark):
    df = spark.createDataFrame([("Retrain now",), ("refit WoE bins",), ("tune the threshold",), ("watch",)], "t string")
    assert [r[0] for r in df.select(cards.action_rank(F.col("t"))).collect()] == [4, 3, 2, 1]


# ── thresholds ──────────────────────────────────────────────────────────────────────────────────


def test_threshold_repair():
    t = Thresholds.from_mapping({"w_completeness": "0.7", "psi_stable": "0.9", "drift_notable": "", "leakage_cardinality": "60.7"})
    assert t.leakage_cardinality == 60 and t.drift_notable == 0.20
    assert t.psi_stable == pytest.approx(0.24)
    assert t.w_completeness + t.w_variance + t.w_mismatch + t.w_governance + t.w_distribution == pytest.approx(1)
    assert Thresholds.from_mapping({}).is_default and not t.is_default


def test_thresholds_are_wired(make_profile):
    p = make_profile({"version": 1, "completeness_percent": 60.0}, {"version": 2, "mean": 60.0, "completeness_percent": 60.0})
    strict = Thresholds(blocker_completeness=70.0, drift_notable=0.3, drift_severe=0.34, psi_stable=-1.0, psi_monitor=-0.5)
    assert single.blockers(single.scored(p)).count() == 0
    assert single.blockers(single.scored(p, strict)).count() == 2
    assert Workspace(p).c4.first()["overall_severity"] == "notable"
    assert Workspace(p, strict).c4.first()["overall_severity"] == "critical"
    assert Workspace(p).c8.first()["worst_label"] == "stable"
    assert Workspace(p, strict).c8.first()["worst_label"] == "shift"
