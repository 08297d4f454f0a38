"""Registered queries: every operator over the same four versioned tables.

The profile of those tables is one job over the whole source tables. Within a session it is computed
once per source folder and then shared by the queries that read profile facts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.operators import cards, compare, drift, exact, interpret_single, pairs, signals, single, themes
from varve.operators import interpret_compare as interpret
from varve.plans import tables
from varve.plans.workspace import Workspace
from varve.sources import payloads, rows, states
from varve.sources import registry as store
from varve.sources.shared import scratch, written
from varve.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_WORKSPACES: dict[tuple[str, str], Workspace] = {}
_COUNTS: dict[tuple[str, str], DataFrame] = {}
_BASICS: dict[tuple[str, str], DataFrame] = {}
_PAIRS: dict[tuple[str, str], DataFrame] = {}


def forget() -> None:
    """Drop the shared stages, so that the next query starts from the source tables."""
    _WORKSPACES.clear()
    _COUNTS.clear()
    _BASICS.clear()
    _PAIRS.clear()
    tables.forget()


def shared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of the four tables, written once per session and source folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _COUNTS:
        _COUNTS[key] = rows.written_counts(tables.specs(spark, sf_dir))
    return _COUNTS[key]


def shared_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, range and mean per group, one small table per session and source folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BASICS:
        _BASICS[key] = written(rows.basic_facts(shared_counts(spark, sf_dir)), "facts")
    return _BASICS[key]


def shared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts on both sides of the version pairs that exact metrics compare."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PAIRS:
        ws = workspace(spark, sf_dir)
        _PAIRS[key] = written(exact.pair_counts(shared_counts(spark, sf_dir), exact.compared(ws.metrics)), "pair-counts")
    return _PAIRS[key]


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WORKSPACES:
        specs = tables.specs(spark, sf_dir)
        if key not in _COUNTS:
            _COUNTS[key] = rows.written_counts(specs)
        _WORKSPACES[key] = Workspace(rows.profile(spark, specs, tables.overrides(spark), counts=_COUNTS[key]))
    return _WORKSPACES[key]


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def shared(name: str) -> Callable[[Callable[[Workspace], DataFrame]], Callable]:
    """Register a query that starts from the shared workspace."""

    def register(fn: Callable[[Workspace], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(workspace(spark, sf_dir))
        return fn

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


VERSION = ["table_name", "version"]
GROUP = ["table_name", "version", "column_name"]


# ── profile from rows ───────────────────────────────────────────────────────────────────────────


@query("R1_profile_rows")
def _(spark, sf_dir):
    p = rows.profile(spark, tables.specs(spark, sf_dir), tables.overrides(spark))
    p = p.select(
        *GROUP, "abt_name", "row_count", "col_seq", "data_type", "cas_data_type", "statistical_scale",
        "completeness_percent", "missing_count", "cardinality_count", "uniqueness_percent", "mean", "std",
        "min_val", "max_val", "skewness", "kurtosis", "q25", "q50", "q75", "has_outliers", "n_outliers",
        "blank_value_count", "mismatched_count", "chars_max_count", "chars_min_count", "has_unique_field",
        "information_privacy",
    )
    return rounded(
        p, 4, "completeness_percent", "uniqueness_percent", "mean", "std", "min_val", "max_val", "skewness",
        "kurtosis", "q25", "q50", "q75",
    )


@query("R2_completeness")
def _(spark, sf_dir):
    long = rows.melt_all(tables.specs(spark, sf_dir))
    return long.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.when(F.col("has"), 0).otherwise(1)).alias("missing_count"),
        F.round(100.0 * F.count_if("has") / F.count(F.lit(1)), 6).alias("completeness_percent"),
    )


@query("R3_cardinality")
def _(spark, sf_dir):
    facts = rows.shown(shared_facts(spark, sf_dir)).join(rows.column_catalog(spark, tables.specs(spark, sf_dir)), ["table_name", "column_name"])
    facts = facts.withColumn("cardinality_count", F.when(F.col("data_type") != "other", F.col("cardinality_count")))
    return facts.select(
        *GROUP, "row_count", "cardinality_count", F.round(100.0 * F.col("cardinality_count") / F.col("row_count"), 6).alias("uniqueness_percent")
    )


@query("R4_outliers")
def _(spark, sf_dir):
    counts, stats = shared_counts(spark, sf_dir), shared_facts(spark, sf_dir)
    quartiles = written(rows.exact_quartiles(counts, stats), "quartiles")
    facts = rows.shown(rows.value_facts(counts, stats, quartiles, tables.specs(spark, sf_dir))).where("q50 is not null")
    out = rounded(facts.select(*GROUP, "n_outliers", "q25", "q50", "q75"), 4, "q25", "q50", "q75")
    return out.withColumn("has_outliers", F.col("n_outliers") > 0)


@query("R5_value_extremes")
def _(spark, sf_dir):
    stats = shared_facts(spark, sf_dir)
    facts = rows.frequency_extremes(shared_counts(spark, sf_dir), stats, tables.specs(spark, sf_dir))
    extremes = facts.select(
        *GROUP, F.col("top_num").alias("mode_num"), F.col("top_txt").alias("mode_txt"),
        F.col("low_num").alias("rarest_num"), F.col("low_txt").alias("rarest_txt"),
    )
    return rows.shown(extremes.join(stats.select(*GROUP, F.col("top_cnt").alias("mode_count")), GROUP))


@shared("R6_scale_inference")
def _(ws):
    return (
        ws.profiles.withColumn("inferred_scale", rows.infer_scale())
        .select(*GROUP, "inferred_scale", "statistical_scale")
        .withColumn("declared", F.col("inferred_scale") != F.col("statistical_scale"))
    )


@query("R7_mismatch_blank")
def _(spark, sf_dir):
    long = rows.melt_all(tables.specs(spark, sf_dir)).where("blank is not null")
    return long.groupBy(*GROUP).agg(
        F.count_if("miss").alias("mismatched_count"), F.count_if("blank").alias("blank_value_count")
    )


# ── single-version analysis ─────────────────────────────────────────────────────────────────────


@shared("S0_readiness_score")
def _(ws):
    return ws.s0


@shared("S1_health_summary")
def _(ws):
    return ws.s1.drop("snapshot_date")


@shared("S2_blockers")
def _(ws):
    return rounded(ws.s2.select(*GROUP, "rule", "completeness_percent", "mismatch_rate"), 6, "completeness_percent", "mismatch_rate")


@shared("S3_warnings")
def _(ws):
    return rounded(
        ws.s3.select(*GROUP, "issue", "completeness_percent", "missing_count", "mismatched_count", "blank_value_count"),
        6, "completeness_percent",
    )


@shared("S4_governance")
def _(ws):
    return ws.s4.select(*GROUP, "risk_type", "cardinality_count")


@shared("S5_readiness")
def _(ws):
    return ws.s5.select(*GROUP, "ordinal_position", "status", "governed", "warned")


@shared("S6_target_analysis")
def _(ws):
    return rounded(ws.s6.drop("recommendations"), 6, "completeness")


@shared("S7_distribution_health")
def _(ws):
    return rounded(ws.s7.drop("col_seq", "mean", "std"), 4, "min_val", "max_val", "q25", "q50", "q75")


@shared("S8_column_health")
def _(ws):
    return ws.s8.drop("col_seq", "top_issue")


@shared("S8t_top_issue")
def _(ws):
    kinds = ws.scored.select(*GROUP, "worst_dim", single.top_issue().alias("issue"))
    return kinds.select(*GROUP, "worst_dim", (F.length("issue") > 0).alias("has_issue_text"))


@shared("S9_action_list")
def _(ws):
    return ws.s9.select(*GROUP, "rule", "severity", "impact", "effort", "priority_score", "action_rank")


@shared("S11_status_counts")
def _(ws):
    return single.status_counts(ws.scored)


@shared("S11_worst_first")
def _(ws):
    return single.worst_first(ws.scored).select(*GROUP, "score", "health_rank")


@shared("K1_analysis_export")
def _(ws):
    sheet = ws.k1.select(
        "table_name", "version", "row_count", "column_name", "statistical_scale", "completeness_pct", "cardinality",
        "uniqueness_pct", "mean", "std", "q25", "q50", "q75", "n_outliers", "readiness_status", "health_score",
        "health_label", "is_blocker", "is_governance_risk", "governance_risk_types",
    )
    return rounded(sheet, 4, "completeness_pct", "uniqueness_pct", "mean", "std", "q25", "q50", "q75")


# ── pairs and drift metrics ─────────────────────────────────────────────────────────────────────

PAIR = ["table_name", "column_name", "pair_idx"]
COLUMN = ["table_name", "column_name"]


@shared("X1_consecutive_pairs")
def _(ws):
    return ws.metrics.select(
        *PAIR, "from_ver", "to_ver", "last_pair", F.col("a").isNotNull().alias("in_from"), F.col("b").isNotNull().alias("in_to")
    )


@shared("X2_first_version_pairs")
def _(ws):
    return pairs.against_first(ws.grid).select(
        *PAIR, "to_ver", F.col("a").isNotNull().alias("in_first"), F.col("b").isNotNull().alias("in_later")
    )


@shared("X3_column_universe")
def _(ws):
    return pairs.column_universe(ws.scored)


def _metric(ws, *names):
    return rounded(drift.suite_scope(ws.metrics).select(*PAIR, *names), 4, *[n for n in names if not _is_label(n)])


def _is_label(name):
    return name.endswith(("severity", "direction", "point", "quantile", "label", "applicable"))


@shared("D1_cv_drift")
def _(ws):
    return _metric(ws, "cv_base", "cv_new", "cv_change", "cv_severity")


@shared("D2_std_drift")
def _(ws):
    return _metric(ws, "std_change", "std_direction", "std_severity")


@shared("D3_quantile_shift")
def _(ws):
    return _metric(ws, "iqr_base", "q1_shift", "median_shift", "q3_shift", "max_quantile_shift", "worst_quantile", "quantile_severity")


@shared("D4_boundary_drift")
def _(ws):
    return _metric(ws, "lower_shift", "upper_shift", "max_boundary_shift", "boundary_severity")


@shared("D5_kurtosis_drift")
def _(ws):
    return _metric(ws, "kurtosis_delta", "kurtosis_severity")


@shared("D6_entropy_drift")
def _(ws):
    return _metric(ws, "entropy_base", "entropy_new", "entropy_change", "entropy_severity")


@shared("D7_ks_approx")
def _(ws):
    return _metric(ws, "ks", "ks_point", "ks_severity")


@shared("D8_psi_union")
def _(ws):
    return ws.metrics.select(*PAIR, "psi", "psi_label", "psi_applicable")


@shared("D8_psi_buckets")
def _(ws):
    return rounded(drift.psi_buckets(ws.metrics), 6, "base_share", "new_share", "contrib").drop("bucket")


@shared("D9_psi_categorical_proxy")
def _(ws):
    return ws.metrics.where("a.data_type = 'char' and b is not null").select(*PAIR, "psi", "psi_label")


@shared("D10_psi_base_edges")
def _(ws):
    return drift.legacy_psi(ws.metrics, ws.cfg)


@shared("D11_feature_stability")
def _(ws):
    return rounded(drift.stability_notes(ws.d11).select(*COLUMN, "n_pairs", "mean_psi", "fsi", "fsi_label", "fsi_note"), 4, "mean_psi")


@shared("D12_drift_velocity")
def _(ws):
    return drift.stability_notes(ws.d11).select(*COLUMN, "n_pairs", "velocity", "velocity_label", "velocity_note")


@shared("D13_baseline_drift")
def _(ws):
    return ws.baseline.select(*PAIR, "to_ver", "psi", "psi_label", "psi_applicable")


@shared("D13_baseline_worst")
def _(ws):
    return ws.d13


@shared("D14_metric_notes")
def _(ws):
    """D1 to D8 of every pair, one row per metric, with a finding or the reason why there is none."""
    return rounded(drift.metric_notes(ws.metrics).select(*PAIR, "metric", "value", "severity", "applicable", "note"), 4, "value")


@shared("D14_all_metrics")
def _(ws):
    return _metric(
        ws, "cv_change", "std_change", "max_quantile_shift", "max_boundary_shift", "kurtosis_delta", "entropy_change",
        "ks", "psi", "psi_label", "cv_severity", "std_severity", "quantile_severity", "boundary_severity",
        "kurtosis_severity", "entropy_severity", "ks_severity",
    )


# ── version comparison ──────────────────────────────────────────────────────────────────────────


def _joined(*names):
    return {n: F.concat_ws(",", n) for n in names}


@shared("C0_verdict")
def _(ws):
    return ws.c0.drop("message").withColumns(_joined("shift_columns"))


@shared("C1_version_summary")
def _(ws):
    return ws.c1_versions.drop("snapshot_date")


@shared("C1_pair_summary")
def _(ws):
    return ws.c1.drop("last_pair").withColumns(_joined("added", "dropped", "worsened", "improved"))


@shared("C2_schema_changes")
def _(ws):
    return rounded(ws.c2.drop("last_pair"), 6, "completeness")


@shared("C3_completeness_changes")
def _(ws):
    return ws.c3_changes


@shared("C3_completeness_series")
def _(ws):
    return rounded(ws.c3.drop("n_versions"), 6, "first_comp", "last_comp")


@shared("C3_completeness_values")
def _(ws):
    return rounded(compare.version_values(ws.grid, "completeness_percent"), 6, "completeness_percent")


@shared("C6_quality_values")
def _(ws):
    bad = ws.c6.select("table_name", "column_name")
    return compare.version_values(ws.grid, "mismatched_count", "blank_value_count").join(bad, ["table_name", "column_name"], "left_semi")


@shared("C7_statuses")
def _(ws):
    return compare.version_values(ws.grid, "status").withColumn("status", F.coalesce("status", F.lit("absent")))


@shared("C9_scores")
def _(ws):
    return compare.version_values(ws.grid, "score")


@shared("C10_cardinalities")
def _(ws):
    return compare.version_values(ws.grid, "cardinality_count")


@shared("S11_caution_columns")
def _(ws):
    """S11 filter: the columns of one readiness status."""
    return single.by_status(ws.scored, "caution").select(*GROUP, "status")


@shared("C12_name_search")
def _(ws):
    """C12 search: columns whose name holds a part, in any case."""
    return compare.find_columns(ws.c12, "ID").select("table_name", "column_name", "worst_label", "overview_rank")


@shared("C3p_missing_pattern")
def _(ws):
    return ws.c3.groupBy("table_name", "missing_pattern").agg(F.count(F.lit(1)).alias("columns"))


@shared("C4_drift_flags")
def _(ws):
    return ws.c4_flags.drop("last_pair")


@shared("C4_distribution_drift")
def _(ws):
    return ws.c4


@shared("C4s_version_stats")
def _(ws):
    return rounded(compare.version_stats(ws.grid), 4, "mean", "std", "skewness", "min_val", "max_val")


@shared("C5_target_rates")
def _(ws):
    return ws.c5_rates


@shared("C5_target_drift")
def _(ws):
    return ws.c5


@shared("C6_quality_regression")
def _(ws):
    return ws.c6


@shared("C7_readiness_change")
def _(ws):
    return ws.c7


@shared("C8_psi_worst")
def _(ws):
    return ws.c8


@shared("C8_psi_summary")
def _(ws):
    return ws.c8_summary.withColumns(_joined("critical_columns"))


@shared("C8h_psi_heatmap")
def _(ws):
    return compare.psi_heatmap(ws.metrics)


@shared("C9_health_trend")
def _(ws):
    return ws.c9


@shared("C9_dataset_trend")
def _(ws):
    return ws.c9_dataset


@shared("C10_cardinality_drift")
def _(ws):
    return ws.c10


@shared("C12_overview_matrix")
def _(ws):
    return rounded(ws.c12, 6, "last_comp")


@shared("C13_quantile_trend")
def _(ws):
    return rounded(compare.quantile_trend(ws.grid), 4, "value")


@shared("C13_ridge_density")
def _(ws):
    return rounded(compare.ridge_density(ws.grid), 4, "lo", "hi", "density")


# ── interpretations ─────────────────────────────────────────────────────────────────────────────


@shared("I1_feature_verdicts")
def _(ws):
    return ws.i1.select(*GROUP, "verdict", "cause", "effort", F.size("steps").alias("n_steps"), "verdict_rank")


@shared("I1_ordered_steps")
def _(ws):
    return ws.i1.select(*GROUP, F.posexplode("steps").alias("step_seq", "s")).select(*GROUP, "step_seq", "s.*")


@shared("I2_training_readiness")
def _(ws):
    return rounded(ws.i2, 6, "completeness")


@shared("I3_preprocessing_checklist")
def _(ws):
    return ws.i3.drop("instruction")


@shared("S11_verdict_counts")
def _(ws):
    return interpret_single.verdict_counts(ws.i1)


@shared("I4_population_shift")
def _(ws):
    return ws.i4.withColumns(_joined("drifted_features"))


@shared("I5_target_stability")
def _(ws):
    return ws.i5


@shared("I6_feature_impact")
def _(ws):
    return ws.i6.drop("model_impact", "fix")


def _action(df):
    return df.drop("steps").withColumns(_joined("accelerating_cols", "unstable_cols", "drifted_columns"))


@shared("I7_model_action")
def _(ws):
    return _action(ws.i7)


@shared("I8_break_risks")
def _(ws):
    return ws.i8.drop("fix")


_FEED_LISTS = ["affected_columns", "sparse_columns", "recovering_columns", "quality_regressing"]


@shared("I9_feed_health")
def _(ws):
    return ws.i9.withColumns(_joined(*_FEED_LISTS))


def _scores(df):
    return df.withColumn(
        "dataset_scores", F.concat_ws(",", F.transform("dataset_scores", lambda s: s["score"].cast("string")))
    )


@shared("I4b_population_history")
def _(ws):
    return _scores(ws.i4b).select("table_name", "shift_scope", "refined_cause", "trend_slope", "trend_direction", "dataset_scores")


@shared("I4b_drifted_score_history")
def _(ws):
    return interpret.drifted_score_history(ws.i4, ws.grid)


@shared("I5b_target_history")
def _(ws):
    return ws.i5b.select("table_name", "drift_type", "refined_drift_type", F.inline_outer("rate_series"))


@shared("I6b_feature_history")
def _(ws):
    return ws.i6b.select(*COLUMN, "drift_cause", "drift_mechanism", F.inline("psi_series"))


@shared("I7b_action_history")
def _(ws):
    return _scores(ws.i7b).select("table_name", "decision", "refined_decision", "drift_type", "total_drift_pp", "dataset_scores")


@shared("I8b_break_risks")
def _(ws):
    return ws.i8b.select(*COLUMN, "risk", "severity", "risk_rank")


@shared("I9b_feed_history")
def _(ws):
    return _scores(ws.i9b).select("table_name", "feed_health", "pattern", "failure_mode", "dataset_scores")


@shared("I4c_population_refined")
def _(ws):
    return ws.i4c.select("table_name", "sampling_signal", "coordinated", "v1_distance", "refined_cause")


@shared("I5c_target_refined")
def _(ws):
    return ws.i5c.select("table_name", "drift_type", "refined_drift_type")


@shared("I6c_feature_refined")
def _(ws):
    return ws.i6c.select(*COLUMN, "drift_mechanism", "median_abs", "mean_delta", "upper_abs", "std_norm")


@shared("I7c_action_refined")
def _(ws):
    return ws.i7c.select("table_name", "decision", "refined_decision", "velocity_flag", F.size("unstable_cols").alias("unstable_count"))


@shared("I8c_risk_priority")
def _(ws):
    return ws.i8c.select(*COLUMN, "risk", "severity", "priority")


@shared("I9c_failure_mode")
def _(ws):
    return ws.i9c.select("table_name", "degrading_count", "total_cols", "failure_mode")


# ── signals, themes, cards ──────────────────────────────────────────────────────────────────────


@shared("C0_issues")
def _(ws):
    return ws.c0_issues


@shared("G1_metric_rows")
def _(ws):
    return signals.metric_rows(ws.facts).select(*COLUMN, "metric_type", "severity")


@shared("G2_magnitude")
def _(ws):
    return signals.metric_rows(ws.facts).select(*COLUMN, "metric_type", "is_private", "magnitude")


@shared("G3_column_signals")
def _(ws):
    return ws.signals_v1.where("metric_type <> 'schema'").select(
        *COLUMN, "metric_type", "severity", "magnitude", F.size("supporting").alias("n_supporting"),
        F.concat_ws(",", F.transform("supporting", lambda s: s["metric_type"])).alias("supporting"),
    )


@shared("G4_root_cause")
def _(ws):
    return ws.signals_v1.select(*COLUMN, "metric_type", "root_cause")


@shared("G5_slot")
def _(ws):
    return ws.signals_v1.select(*COLUMN, "metric_type", "slot", "is_private")


@shared("G6_direction")
def _(ws):
    return ws.signals_v1.select(*COLUMN, "metric_type", "direction")


@shared("G7_schema_signals")
def _(ws):
    return signals.schema_signals(ws.c2, ws.facts).select(*COLUMN, "severity", "magnitude", "direction", "slot")


@shared("G8_private_columns")
def _(ws):
    return signals.private_columns(ws.scored)


@shared("G9_signals")
def _(ws):
    return ws.signals_v1.select(*COLUMN, "metric_type", "severity", "magnitude", "root_cause", "direction", "slot", "signal_rank")


@shared("G10_slot_severity")
def _(ws):
    return signals.slot_severity(ws.signals_v1)


@shared("G10_top_population")
def _(ws):
    return signals.top_population(ws.signals_v1).select(*COLUMN, "slot_rank", "magnitude")


_FACTS = [
    "psi", "mean_before", "mean_after", "mean_delta", "mean_delta_pct", "completeness_before", "completeness_after",
    "q1_shift", "median_shift", "q3_shift", "iqr_base", "min_base", "min_new", "max_base", "max_new", "upper_shift",
    "lower_shift", "std_base", "std_new", "std_change", "cv_base", "cv_new", "cv_change", "baseline_psi", "fsi",
    "fsi_mean_psi", "velocity",
]


@shared("G11_raw_facts")
def _(ws):
    labels = ["psi_label", "psi_worst_pair", "worst_quantile", "baseline_label", "fsi_label", "velocity_label"]
    return rounded(ws.facts.select(*COLUMN, *_FACTS, *labels), 4, *_FACTS)


@shared("G12_composite_importance")
def _(ws):
    return ws.facts.select(*COLUMN, signals.composite_importance().alias("importance"))


@shared("G13_signals_composite")
def _(ws):
    return ws.signals_v2.select(*COLUMN, "metric_type", "severity", "magnitude", "slot", "signal_rank")


@shared("G14_rule_signals")
def _(ws):
    return ws.rules


@shared("H1_signal_themes")
def _(ws):
    return themes.assign_themes(ws.signals_v2).select(*COLUMN, "metric_type", "theme_id")


@shared("H2_theme_groups")
def _(ws):
    return ws.themes.select("table_name", "theme_id", "theme_rank", "n_columns", "max_importance", "worst_column", F.concat_ws(",", "columns").alias("columns"))


@shared("H3_theme_facts")
def _(ws):
    names = [
        "worst_psi", "worst_mean_delta_pct", "mean_before", "mean_after", "worst_median_shift", "worst_q1_shift",
        "worst_q3_shift", "iqr_base", "min_base", "min_new", "max_base", "max_new", "std_base", "std_new",
        "worst_std_change", "completeness_before", "completeness_after", "baseline_psi", "worst_velocity", "worst_fsi",
    ]
    labels = ["worst_psi_label", "worst_psi_pair", "baseline_label", "fsi_label"]
    return rounded(ws.themes.select("table_name", "theme_id", *names, *labels), 4, *names)


@shared("H4_theme_domain")
def _(ws):
    return ws.themes.select("table_name", "theme_id", "theme_domain", "theme_label")


@shared("H5_fact_sheet")
def _(ws):
    return themes.fact_sheet(ws.themes).select("table_name", "theme_id", "n_lines")


@shared("B1_theme_cards")
def _(ws):
    return ws.theme_cards.select("table_name", "theme_rank", "theme_id", "theme_domain", "headline", "severity", "decision", "psi", "n_columns")


@shared("B2_fallback_cards")
def _(ws):
    return themes.fallback_cards(ws.rules)


@shared("B3_root_cause_analysis")
def _(ws):
    return cards.diagnosed(ws.signals_v1).select(*COLUMN, "metric_type", "drift_cause", "is_real_drift")


@shared("B4_evidence_rows")
def _(ws):
    ev = cards.evidence_rows(cards.diagnosed(ws.signals_v1))
    return ev.select(*COLUMN, "drift_cause", F.size("evidence").alias("n_evidence"), F.col("evidence")[0]["label"].alias("first_label"))


@shared("B5_headline_causes")
def _(ws):
    stories = cards.drift_stories(ws.signals_v1)
    return stories.select("table_name", "slot", "drift_cause", "headline", "impact_and_action")


@shared("B6_drift_stories")
def _(ws):
    stories = cards.drift_stories(ws.signals_v1)
    return stories.select("table_name", "slot", "severity", "column_name", "metric_type", "drift_cause", "magnitude")


def _card_facts(df):
    return df.select("table_name", "slot", "severity", F.size("evidence").alias("n_evidence"))


@shared("B7_target_card")
def _(ws):
    return _card_facts(cards.target_card(ws.i5, ws.c5))


@shared("B8_feed_card")
def _(ws):
    return _card_facts(cards.feed_card(ws.i9, ws.signals_v1))


@shared("B9_model_risk_card")
def _(ws):
    return _card_facts(cards.risk_card(ws.i6, ws.i7, ws.i8, ws.signals_v1))


@shared("B10_governance_card")
def _(ws):
    return _card_facts(cards.governance_card(ws.c0, ws.signals_v1))


@shared("B11_card_order")
def _(ws):
    return ws.cards.select("table_name", "slot", "severity", "card_order")


@shared("B12_decision_view")
def _(ws):
    banner = ws.i7.select("table_name", "decision", "urgency")
    return _card_facts(ws.cards).join(banner, "table_name", "left")


@shared("V1_card_validation")
def _(ws):
    return ws.validated_cards.select(
        "table_name", "slot", "is_private", "has_loss", "original_rank", "final_rank", "fired_rules", "validation_passed"
    )


@shared("N1_narratives")
def _(ws):
    return ws.narratives


@shared("N2_story_facts")
def _(ws):
    names = ["psi", "mean_before", "mean_after", "mean_delta", "median_shift", "upper_shift", "lower_shift", "std_change", "completeness_before", "completeness_after"]
    return rounded(cards.story_facts(ws.signals_v1), 4, *names)


# ── payloads, registry, store ───────────────────────────────────────────────────────────────────

_PAYLOAD_CHECK = [
    "row_count", "col_seq", "data_type", "statistical_scale", "completeness_percent", "missing_count",
    "cardinality_count", "mean", "std", "q25", "q50", "q75", "has_outliers", "n_outliers", "blank_value_count",
    "mismatched_count", "information_privacy", "has_unique_field",
]


def _payload_facts(docs):
    out = payloads.profiles(docs).select(*GROUP, *_PAYLOAD_CHECK)
    return rounded(out, 4, "completeness_percent", "mean", "std", "q25", "q50", "q75")


@shared("R8_json_profiles")
def _(ws):
    """Written as JSON files by version, read back and parsed."""
    spark = ws.profiles.sparkSession
    folder = scratch(spark, "payloads")
    payloads.to_payloads(ws.profiles).select("payload", "table_name", "version").write.partitionBy("table_name", "version").text(folder)
    files = spark.read.text(folder).withColumnRenamed("value", "payload")
    return _payload_facts(payloads.documents(files))


@shared("R9_double_encoded")
def _(ws):
    """The same documents quoted, embedded in text, flat or as bare lists, depending on the version."""
    p = payloads.to_payloads(ws.profiles)
    quoted = F.expr("substring(to_json(array(payload)), 2, length(to_json(array(payload))) - 2)")
    listed = F.get_json_object("payload", "$.items")
    kind = F.col("version") % 3
    broken = F.when(kind == 0, quoted).when(kind == 1, F.concat(F.lit("body = "), F.col("payload"), F.lit(" ;"))).otherwise(listed)
    out = payloads.profiles(payloads.documents(p.withColumn("payload", broken)))
    return rounded(out.select(*GROUP, "col_seq", "completeness_percent", "cardinality_count", "statistical_scale"), 4, "completeness_percent")


@shared("R10_content_hash")
def _(ws):
    """Documents, and the same documents with reversed items: equal digests."""
    docs = payloads.documents(payloads.to_payloads(ws.profiles))
    turned = docs.withColumn("doc", F.col("doc").withField("items", F.reverse("doc.items")))
    both = payloads.content_hash(docs).unionByName(payloads.content_hash(turned))
    return both.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("hash").alias("distinct_hashes"), F.max(F.length("hash")).alias("digits")
    )


def _arrivals(ws):
    """All versions in order, then the first version of each table once more."""
    docs = payloads.content_hash(payloads.documents(payloads.to_payloads(ws.profiles)))
    numbered = docs.select(
        "table_name", "hash", F.col("doc.abt_snapshot.row_count").alias("row_count"), F.col("doc.abt_snapshot.snapshot_date").alias("snapshot_date"),
        F.row_number().over(Window.partitionBy("table_name").orderBy("version")).alias("arrival"),
    )
    return numbered.unionByName(numbered.where("arrival = 1").withColumn("arrival", F.lit(1000)))


@shared("R11_registry_ingest")
def _(ws):
    return store.classify(_arrivals(ws), store.empty(ws.profiles.sparkSession)).select("table_name", "arrival", "version", "action")


@shared("R11_second_batch")
def _(ws):
    """A stored registry of the first two versions meets a batch with all versions: two are known, the rest are new."""
    spark = ws.profiles.sparkSession
    path = scratch(spark, "registry")
    arrivals = _arrivals(ws).where("arrival < 1000")
    first = store.classify(arrivals.where("arrival <= 2"), store.empty(spark))
    store.write_registry(store.ingest(store.empty(spark), first, "2024-01-01"), path)
    return store.classify(arrivals, store.read_registry(spark, path)).select("table_name", "arrival", "version", "action")


@shared("R12_snapshot_fallback")
def _(ws):
    """Row count and name when a document carries no snapshot."""
    p = payloads.to_payloads(ws.profiles)
    bare = p.withColumn("payload", F.concat(F.lit('{"count":77,"items":'), F.get_json_object("payload", "$.items"), F.lit("}")))
    return payloads.profiles(payloads.documents(bare)).groupBy("table_name", "version").agg(
        F.max("row_count").alias("row_count"), F.max("abt_name").alias("abt_name"), F.bool_or("row_count_measured").alias("measured")
    )


def _registered(ws):
    batch = store.classify(_arrivals(ws), store.empty(ws.profiles.sparkSession))
    return store.ingest(store.empty(ws.profiles.sparkSession), batch, "2024-01-01")


@shared("R13_list_tables")
def _(ws):
    return store.list_tables(_registered(ws)).withColumn("versions", F.concat_ws(",", "versions")).drop("created_at")


@shared("R13_table_versions")
def _(ws):
    return store.table_versions(_registered(ws), "abt_orders").select("table_name", "version", "row_count")


@shared("R13_resolve")
def _(ws):
    return store.resolve(_registered(ws), "abt_orders", 2).select("table_name", "version", "row_count")


@shared("R14_version_load")
def _(ws):
    """K2 store written and one version read back through its partition."""
    spark = ws.profiles.sparkSession
    path = scratch(spark, "store")
    store.write_store(ws.profiles, path)
    one = store.load_version(store.read_store(spark, path), "abt_orders", 2000)
    return one.select("table_name", "version", "column_name", "row_count", "missing_count", "cardinality_count")


@shared("K2_version_store")
def _(ws):
    spark = ws.profiles.sparkSession
    path = scratch(spark, "store")
    store.write_store(ws.profiles, path)
    return store.read_store(spark, path).groupBy("table_name", "version").agg(
        F.count(F.lit(1)).alias("columns"), F.sum("missing_count").alias("missing_cells")
    )


# ── exact drift from rows ───────────────────────────────────────────────────────────────────────


@query("D6x_entropy_exact")
def _(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    out = exact.entropy_drift(shared_counts(spark, sf_dir), ws.metrics)
    return rounded(out, 4, "entropy_base", "entropy_new", "entropy_change")


@query("D7x_ks_exact")
def _(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return rounded(exact.ks_exact(shared_pairs(spark, sf_dir), ws.metrics), 6, "ks")


@query("D8x_psi_exact")
def _(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return rounded(exact.psi_exact(shared_counts(spark, sf_dir), ws.metrics), 6, "psi")


@query("D8x_psi_deciles")
def _(spark, sf_dir):
    ws, counts = workspace(spark, sf_dir), shared_counts(spark, sf_dir)
    deciles = written(rows.exact_quantiles(counts, shared_facts(spark, sf_dir), [i / 10 for i in range(1, 10)]), "deciles")
    return rounded(exact.psi_exact_bins(counts, ws.metrics, deciles), 6, "psi")


@query("D9x_psi_categorical_exact")
def _(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return rounded(exact.psi_categorical_exact(shared_pairs(spark, sf_dir), ws.metrics), 6, "psi")


# ── streaming ───────────────────────────────────────────────────────────────────────────────────


#: The numeric and text columns of the stream; the SQL answer of M1 has the numeric ones.
STREAMED = ["event_id", "user_id", "value"]
STREAMED_TEXTS = ["event_type", "props"]


def _windows(spark, sf_dir, texts=()):
    return windows.windowed_profile(windows.read_events(spark, sf_dir, "events.parquet"), "events", "ts", STREAMED, texts=texts)


@query("M1_windowed_profile")
def _(spark, sf_dir):
    path = scratch(spark, "windows")
    windows.run_to_table(_windows(spark, sf_dir), path, f"{path}-state")
    finished = spark.read.parquet(path)
    rest = windows.close_open(spark.read.parquet(f"{sf_dir}/events.parquet"), "events", "ts", STREAMED, finished)
    out = finished.unionByName(rest).select("table_name", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "column_name", "row_count", "n_present", "min_val", "max_val", "mean", "std")
    return rounded(out, 4, "mean", "std")


@query("M2_drift_alerts")
def _(spark, sf_dir):
    path = scratch(spark, "alerts")
    store = f"{path}-store"
    windows.run_alerts(_windows(spark, sf_dir, STREAMED_TEXTS), store, path, f"{path}-state")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rest = windows.close_open(events, "events", "ts", STREAMED, spark.read.parquet(store), texts=STREAMED_TEXTS)
    return spark.read.parquet(path).drop("batch").unionByName(windows.close_alerts(rest, store)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ["window_start", "base_start"]})


@query("R3_sketch_profile")
def _(spark, sf_dir):
    """Sketch mode beside the exact facts: exact counts as they are, estimates by whether they keep their tolerance.

    Distinct values within 5 %, every quartile's rank within 1 % of the rows (or one row), and the mode and the rarest
    value themselves where sketch mode gives them.
    """
    p = rows.profile(spark, tables.specs(spark, sf_dir), tables.overrides(spark), mode="sketch")
    p = p.withColumns({"version": F.coalesce("version", F.lit(rows.NO_VERSION))})
    counts, exact_facts = shared_counts(spark, sf_dir), shared_facts(spark, sf_dir)
    ranks = counts.where("num is not null").join(p.select(*GROUP, "q25", "q50", "q75"), GROUP)
    share = lambda cond: F.sum(F.when(cond, F.col("cnt")).otherwise(0)) / F.sum("cnt")
    slack = F.greatest(F.lit(0.01), 1.5 / F.sum("cnt"))
    near = [(share(F.col("num") <= F.col(q)) >= at - slack) & (share(F.col("num") < F.col(q)) <= at + slack) for q, at in zip(["q25", "q50", "q75"], rows.QUARTILES)]
    ranks = ranks.groupBy(*GROUP).agg((near[0] & near[1] & near[2]).alias("quartiles_near"))
    distinct = exact_facts.select(*GROUP, F.col("cardinality_count").alias("exact_distinct"))
    out = p.join(distinct, GROUP).join(ranks, GROUP, "left")
    near_distinct = F.abs(F.col("cardinality_count") - F.col("exact_distinct")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact_distinct"))
    # groups of few values, all of which sketch mode counts
    few = F.col("exact_distinct") < rows.CANDIDATES
    is_number = F.col("data_type") == "num"
    value = lambda c: [F.when(few & is_number, F.col(c)).try_cast("double"), F.when(few & ~is_number, F.col(c))]
    (mode_num, mode_txt), (rarest_num, rarest_txt) = value("most_common_value"), value("least_common_value")
    out = out.select(
        *GROUP, "row_count", "missing_count", "min_val", "max_val", "mean",
        # true where there is nothing to estimate
        F.coalesce("quartiles_near", F.lit(True)).alias("quartiles_near"),
        F.coalesce(near_distinct, F.lit(True)).alias("distinct_near"),
        mode_num.alias("mode_num"), mode_txt.alias("mode_txt"), rarest_num.alias("rarest_num"), rarest_txt.alias("rarest_txt"),
    )
    return rounded(rows.shown(out), 4, "min_val", "max_val", "mean", "mode_num", "rarest_num")


@query("R1_incremental_profile")
def _(spark, sf_dir):
    """All tables loaded in three parts, the last one in a load of its own; the profile is merged from stored states."""
    path = scratch(spark, "states")
    specs = tables.specs(spark, sf_dir)
    part = lambda s: F.pmod(F.xxhash64(*[F.col(c) for c in s.profiled()[:2]]), F.lit(3))
    parted = [replace(s, rows=s.rows.withColumn("load_no", part(s)), columns=s.profiled()) for s in specs]
    for condition in ("load_no < 2", "load_no = 2"):
        states.write_states(states.partial_states([replace(s, rows=s.rows.where(condition)) for s in parted], "load_no"), path)
    p = states.profile_of_states(spark, states.read_states(spark, path), specs, tables.overrides(spark))
    exact_distinct = rows.shown(shared_facts(spark, sf_dir)).select(
        F.col("table_name").alias("t"), F.col("version").alias("v"), F.col("column_name").alias("c"), F.col("cardinality_count").alias("d")
    )
    same = (F.col("table_name") == F.col("t")) & F.col("version").eqNullSafe(F.col("v")) & (F.col("column_name") == F.col("c"))
    near = F.abs(F.col("cardinality_count") - F.col("d")) <= F.greatest(F.lit(1.0), 0.1 * F.col("d"))
    out = p.join(exact_distinct, same).select(
        *GROUP, "row_count", "missing_count", "min_val", "max_val", "mean", "std", "skewness", "kurtosis", "blank_value_count",
        "mismatched_count", "chars_max_count", "chars_min_count", F.coalesce(near, F.lit(True)).alias("distinct_near"),
    )
    return rounded(out, 4, "min_val", "max_val", "mean", "std", "skewness", "kurtosis")


@query("M1_weekly_rollup")
def _(spark, sf_dir):
    """Days profiled by the stream merge to weeks; no row is read again."""
    path = scratch(spark, "windows")
    windows.run_to_table(_windows(spark, sf_dir, STREAMED_TEXTS), path, f"{path}-state")
    finished = spark.read.parquet(path)
    rest = windows.close_open(spark.read.parquet(f"{sf_dir}/events.parquet"), "events", "ts", STREAMED, finished, texts=STREAMED_TEXTS)
    weeks = windows.merged(finished.unionByName(rest), F.floor(F.unix_date(F.to_date("window_start")) / 7).cast("int"))
    out = weeks.select("table_name", F.col("period").alias("version"), "column_name", "row_count", "n_present", "min_val", "max_val", "mean", "std", "n_blank")
    return rounded(out, 4, "mean", "std")


@query("R7_declared_types")
def _(spark, sf_dir):
    """Texts of orders held against declared types and a pattern, from a rules table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    texts = orders.select(
        F.year("o_orderdate").alias("version"),
        F.when(k % 7 == 0, "unknown").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("day"),
        F.when(k % 11 == 0, F.concat(F.lit("EUR "), k.cast("string"))).when(k % 13 == 0, "").otherwise(k.cast("string")).alias("number"),
        F.col("o_orderpriority").alias("priority"),
    )
    rules = spark.createDataFrame(
        [("orders", "day", "date", None), ("orders", "number", "bigint", None), ("orders", "priority", "int", "^[1-5]-.*$")], rows.RULE_SCHEMA
    )
    p = rows.profile(spark, rows.with_rules([rows.TableSpec("orders", texts)], rules))
    return p.select(*GROUP, "row_count", "blank_value_count", "mismatched_count")


@shared("R15_catalog_rollup")
def _(ws):
    return single.catalog_rollup(ws.scored)


@shared("R11_two_writers")
def _(ws):
    """Two writers start from the same state; the later one is refused, looks again and adds only what is new."""
    spark = ws.profiles.sparkSession
    arrivals = written(_arrivals(ws).where("arrival < 1000"), "arrivals")
    log = store.RegistryLog(spark, scratch(spark, "registry-log"))
    late = arrivals.where("arrival <= 3")
    number, state, _ = log.prepare(late, "2024-01-02")
    log.commit(arrivals.where("arrival <= 2"), "2024-01-01", "first")
    refused = not log.publish(number, state, "second")
    log.commit(late, "2024-01-02", "second")
    log.commit(late, "2024-01-03", "second")
    last, registry = log.latest()
    return registry.select(
        "table_name", "version", "row_count", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("last_seen", "yyyy-MM-dd").alias("seen"), F.lit(last).alias("commits"), F.lit(refused).alias("refused"),
    )
