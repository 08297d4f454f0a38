"""One SQL answer per registered query."""

from __future__ import annotations

from varve import vocab
from varve.operators import cards

from oracle import compose, profile_sql  # noqa: F401  (registers the steps)

ORACLE: dict[str, str] = {}


def answer(name: str, final: str) -> None:
    ORACLE[name] = compose(final)


_G = "table_name, version, column_name"

answer(
    "R1_profile_rows",
    f"""
SELECT {_G}, abt_name, row_count, col_seq, data_type, cas_data_type, statistical_scale,
  round(completeness_percent, 4) AS completeness_percent, missing_count, cardinality_count,
  round(uniqueness_percent, 4) AS uniqueness_percent, round(mean, 4) AS mean, round(std, 4) AS std,
  round(min_val, 4) AS min_val, round(max_val, 4) AS max_val, round(skewness, 4) AS skewness,
  round(kurtosis, 4) AS kurtosis, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, has_outliers,
  n_outliers, blank_value_count, mismatched_count, chars_max_count, chars_min_count, has_unique_field,
  information_privacy FROM prof
""",
)
answer(
    "R2_completeness",
    f"""
SELECT {_G}, count(*) AS row_count,
  count(*) - count(CASE WHEN has THEN 1 END) AS missing_count,
  round(100.0::DOUBLE * count(CASE WHEN has THEN 1 END) / count(*), 6) AS completeness_percent
FROM cells GROUP BY {_G}
""",
)
answer(
    "R3_cardinality",
    f"""
SELECT {_G}, row_count, cardinality_count,
  round(100.0::DOUBLE * cardinality_count / row_count, 6) AS uniqueness_percent FROM prof
""",
)
answer(
    "R4_outliers",
    f"""
SELECT {_G}, n_outliers, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, has_outliers
FROM prof WHERE data_type = 'num' AND q50 IS NOT NULL
""",
)
answer(
    "R5_value_extremes",
    f"""
SELECT {_G}, max(CASE WHEN hi = 1 THEN num END) AS mode_num, max(CASE WHEN hi = 1 THEN k END) AS mode_txt,
  max(CASE WHEN lo = 1 THEN num END) AS rarest_num, max(CASE WHEN lo = 1 THEN k END) AS rarest_txt,
  max(cnt) AS mode_count
FROM (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY cnt DESC, num, k) AS hi,
             row_number() OVER (PARTITION BY {_G} ORDER BY cnt, num, k) AS lo
      FROM (SELECT {_G}, num, k, count(*) AS cnt
            FROM (SELECT *, txt AS k FROM cells)
            WHERE num IS NOT NULL OR k IS NOT NULL GROUP BY {_G}, num, k))
GROUP BY {_G}
""",
)
answer(
    "R6_scale_inference",
    f"""
SELECT {_G}, inferred_scale, statistical_scale, inferred_scale <> statistical_scale AS declared
FROM (SELECT *, CASE WHEN data_type = 'other' THEN 'nested' WHEN cardinality_count <= 1 THEN 'unary' WHEN cardinality_count = 2 THEN 'binary'
         WHEN cardinality_count = row_count AND (data_type = 'char' OR cas_data_type IN ('int', 'bigint')) THEN 'id'
         WHEN data_type = 'char' THEN 'nominal' ELSE 'interval' END AS inferred_scale FROM prof)
""",
)
answer("R7_mismatch_blank", f"SELECT {_G}, mismatched_count, blank_value_count FROM prof WHERE data_type = 'char'")

answer("S0_readiness_score", "SELECT * FROM s0l")
answer(
    "S1_health_summary",
    """
SELECT *, CASE WHEN high_missing + zero_variance + has_mismatches = 0 AND privacy_flagged = 0 THEN 'healthy'
  WHEN high_missing + zero_variance + has_mismatches <= 3 THEN 'caution' ELSE 'critical' END AS overall_health
FROM (SELECT table_name, version, any_value(abt_name) AS abt_name, any_value(row_count) AS row_count,
  count(*) AS total_columns, count(CASE WHEN completeness_percent = 100 THEN 1 END) AS fully_complete,
  count(CASE WHEN b_missing THEN 1 END) AS high_missing, count(CASE WHEN g_privacy THEN 1 END) AS privacy_flagged,
  count(CASE WHEN b_zero THEN 1 END) AS zero_variance,
  count(CASE WHEN mismatched_count > 0 THEN 1 END) AS has_mismatches FROM sc GROUP BY table_name, version)
""",
)
answer(
    "S2_blockers",
    f"""
SELECT {_G}, rule, round(completeness_percent, 6) AS completeness_percent, round(mismatch_rate, 6) AS mismatch_rate
FROM rule_rows JOIN sc USING ({_G}) WHERE source = 0
""",
)
answer(
    "S3_warnings",
    f"""
SELECT {_G}, issue, round(completeness_percent, 6) AS completeness_percent, missing_count, mismatched_count,
  blank_value_count
FROM (SELECT {_G}, rule AS issue FROM rule_rows WHERE source = 2
      UNION ALL SELECT {_G}, 'blank_values' FROM sc WHERE w_blank) JOIN sc USING ({_G})
""",
)
answer(
    "S4_governance",
    f"SELECT {_G}, rule AS risk_type, cardinality_count FROM rule_rows JOIN sc USING ({_G}) WHERE source = 1",
)
answer("S5_readiness", f"SELECT {_G}, col_seq AS ordinal_position, status, governed, warned FROM sc")
answer("S6_target_analysis", "SELECT * REPLACE (round(completeness, 6) AS completeness) FROM s6")
answer(
    "S7_distribution_health",
    """
SELECT * REPLACE (round(min_val, 4) AS min_val, round(max_val, 4) AS max_val, round(q25, 4) AS q25,
  round(q50, 4) AS q50, round(q75, 4) AS q75) FROM s7
""",
)
answer(
    "S8_column_health",
    f"""
SELECT {_G}, score, health_label, p_completeness, p_variance, p_mismatch, p_governance, p_distribution, worst_dim
FROM sc
""",
)
answer("S8t_top_issue", f"SELECT {_G}, worst_dim, true AS has_issue_text FROM sc")
answer(
    "S9_action_list",
    f"""
SELECT {_G}, rule, severity, impact, effort, priority_score,
  row_number() OVER (PARTITION BY table_name, version ORDER BY priority_score DESC, source, col_seq, seq) AS action_rank
FROM action_rows JOIN action_dim USING (rule)
""",
)
answer(
    "S11_status_counts",
    "SELECT table_name, version, status, count(*) AS columns, min(score) AS worst_score FROM sc GROUP BY 1, 2, 3",
)
answer(
    "S11_worst_first",
    f"SELECT {_G}, score, row_number() OVER (PARTITION BY table_name, version ORDER BY score, col_seq) AS health_rank FROM sc",
)
answer(
    "K1_analysis_export",
    """
SELECT abt_name AS table_name, version, row_count, column_name, statistical_scale,
  round(completeness_percent, 4) AS completeness_pct, cardinality_count AS cardinality,
  round(uniqueness_percent, 4) AS uniqueness_pct, round(mean, 4) AS mean, round(std, 4) AS std, round(q25, 4) AS q25,
  round(q50, 4) AS q50, round(q75, 4) AS q75, n_outliers, status AS readiness_status, score AS health_score,
  health_label, blocked AS is_blocker, governed AS is_governance_risk,
  concat_ws(',', CASE WHEN g_identifier THEN 'IDENTIFIER' END, CASE WHEN g_privacy THEN 'PRIVACY' END,
            CASE WHEN prob_like THEN 'LEAKAGE' END) AS governance_risk_types
FROM sc
""",
)

# ── pairs and drift metrics ─────────────────────────────────────────────────────────────────────
from oracle import compare_sql  # noqa: E402,F401

_P = "table_name, column_name, pair_idx"


def _rounded(names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


answer("X1_consecutive_pairs", f"SELECT {_P}, from_ver, to_ver, last_pair, in_a AS in_from, in_b AS in_to FROM pp")
answer(
    "X2_first_version_pairs",
    "SELECT table_name, column_name, to_idx AS pair_idx, to_ver, in_a AS in_first, in_b AS in_later FROM pb",
)
answer("X3_column_universe", "SELECT * FROM uni")
answer("D1_cv_drift", f"SELECT {_P}, {_rounded('cv_base cv_new cv_change')}, cv_severity FROM suite")
answer("D2_std_drift", f"SELECT {_P}, {_rounded('std_change')}, std_direction, std_severity FROM suite")
answer(
    "D3_quantile_shift",
    f"SELECT {_P}, {_rounded('iqr_base q1_shift median_shift q3_shift max_quantile_shift')}, worst_quantile, quantile_severity FROM suite",
)
answer(
    "D4_boundary_drift",
    f"SELECT {_P}, {_rounded('lower_shift upper_shift max_boundary_shift')}, boundary_severity FROM suite",
)
answer("D5_kurtosis_drift", f"SELECT {_P}, {_rounded('kurtosis_delta')}, kurtosis_severity FROM suite")
answer(
    "D6_entropy_drift", f"SELECT {_P}, {_rounded('entropy_base entropy_new entropy_change')}, entropy_severity FROM suite"
)
answer("D7_ks_approx", f"SELECT {_P}, {_rounded('ks')}, ks_point, ks_severity FROM suite")
answer("D8_psi_union", f"SELECT {_P}, psi, psi_label, psi_applicable FROM ppsi")
answer(
    "D8_psi_buckets",
    "\nUNION ALL ".join(
        f"SELECT {_P}, {i} AS bucket_no, round(as{i}, 6) AS base_share, round(bs{i}, 6) AS new_share, "
        f"round((bs{i} - as{i}) * ln(bs{i} / as{i}), 6) AS contrib FROM ppsi "
        "WHERE psi_state = 'ok' AND a_data_type = 'num' AND b_data_type = 'num'"
        for i in range(4)
    ),
)
answer("D9_psi_categorical_proxy", f"SELECT {_P}, psi, psi_label FROM ppsi WHERE a_data_type = 'char' AND in_b")
answer(
    "D10_psi_base_edges",
    f"""
SELECT {_P}, round(raw, 4) AS psi, raw IS NOT NULL AS psi_applicable,
  CASE WHEN raw IS NULL THEN state WHEN raw < 0.1 THEN 'stable' WHEN raw < 0.25 THEN 'monitor' ELSE 'shift' END AS psi_label
FROM (SELECT *, CASE state WHEN 'numeric' THEN
    (greatest(n0 / t, 1e-6) - 0.25) * ln(greatest(n0 / t, 1e-6) / 0.25) + (greatest(n1 / t, 1e-6) - 0.25) * ln(greatest(n1 / t, 1e-6) / 0.25)
    + (greatest(n2 / t, 1e-6) - 0.25) * ln(greatest(n2 / t, 1e-6) / 0.25) + (greatest(n3 / t, 1e-6) - 0.25) * ln(greatest(n3 / t, 1e-6) / 0.25)
    + (greatest(n4 / t, 1e-6) - 1e-6) * ln(greatest(n4 / t, 1e-6) / 1e-6)
    WHEN 'categorical' THEN CASE WHEN a_cardinality_count <> b_cardinality_count
      THEN least(0.15::DOUBLE * abs(a_cardinality_count - b_cardinality_count), 1) ELSE 0 END END AS raw
  FROM (SELECT *, n0 + n1 + n2 + n3 + n4 AS t
    FROM (SELECT *, greatest(0, (least(a_q25, b_max_val) - greatest(a_min_val, b_min_val)) / w * 0.25) AS n0,
        greatest(0, (least(a_q50, b_max_val) - greatest(a_q25, b_min_val)) / w * 0.25) AS n1,
        greatest(0, (least(a_q75, b_max_val) - greatest(a_q50, b_min_val)) / w * 0.25) AS n2,
        greatest(0, (least(a_max_val, b_max_val) - greatest(a_q75, b_min_val)) / w * 0.25) AS n3,
        (greatest(b_max_val - a_max_val, 0) + greatest(a_min_val - b_min_val, 0)) / w AS n4
      FROM (SELECT *, greatest(b_max_val - b_min_val, 1e-9) AS w,
          CASE WHEN NOT (in_a AND in_b) THEN 'absent' WHEN a_data_type <> b_data_type THEN 'type_changed'
            WHEN a_data_type = 'num' AND a_statistical_scale NOT IN ('id', 'binary', 'unary')
              THEN CASE WHEN a_q50 IS NULL THEN 'insufficient_data' ELSE 'numeric' END
            WHEN a_data_type = 'char' AND a_statistical_scale IN ('binary', 'nominal') THEN 'categorical'
            ELSE 'not_applicable' END AS state FROM pp))))
""",
)
_PCT = lambda x: f"coalesce(CAST(TRY_CAST(round(({x}) * 100) AS DECIMAL(38,0)) AS VARCHAR), 'very many')"
answer(
    "D11_feature_stability",
    f"""
SELECT table_name, column_name, n_pairs, round(mean_psi, 4) AS mean_psi, fsi, fsi_label,
  CASE WHEN fsi IS NULL THEN 'No pair of versions has an index.' ELSE 'Stable to ' || {_PCT('fsi')} || ' % over ' || n_pairs || ' pairs.' END AS fsi_note FROM d11
""",
)
answer(
    "D12_drift_velocity",
    f"""
SELECT table_name, column_name, n_pairs, velocity, velocity_label, CASE WHEN velocity IS NULL THEN 'Two pairs are needed for a trend.'
  WHEN velocity > 0 THEN 'Drift grows by ' || {_PCT('velocity')} || ' hundredths a version.'
  WHEN velocity < 0 THEN 'Drift falls by ' || {_PCT('-velocity')} || ' hundredths a version.' ELSE 'Drift neither grows nor falls.' END AS velocity_note FROM d11
""",
)
_ABSENT = "WHEN NOT (in_a AND in_b) THEN 'the column is missing from one of the versions'"
_NUMERIC = _ABSENT + " WHEN a_data_type <> 'num' OR b_data_type <> 'num' THEN 'not a numeric column'"
_NULLS = lambda *names: " OR ".join(f"{s}_{n} IS NULL" for n in names for s in "ab")
_REASONS = {
    "cv_drift": f"{_NUMERIC} WHEN {_NULLS('mean', 'std')} THEN 'mean or spread unknown' WHEN abs(a_mean) < 1e-6 THEN 'the earlier mean is about zero' WHEN cv_change IS NULL THEN 'the later mean is about zero'",
    "std_drift": f"{_NUMERIC} WHEN {_NULLS('std')} THEN 'spread unknown' WHEN a_std < 1e-9 THEN 'the earlier spread is about zero'",
    "quantile_shift": f"{_NUMERIC} WHEN {_NULLS('q25', 'q50', 'q75')} THEN 'quartiles unknown'",
    "boundary_drift": f"{_NUMERIC} WHEN {_NULLS('min_val', 'max_val')} THEN 'limits unknown'",
    "kurtosis_drift": f"{_NUMERIC} WHEN {_NULLS('kurtosis')} THEN 'kurtosis unknown'",
    "entropy_drift": f"{_ABSENT} WHEN a_data_type = 'num' AND a_statistical_scale <> 'binary' THEN 'a numeric column, see its quantiles' "
    "WHEN coalesce(least(a_cardinality_count, b_cardinality_count), 0) <= 0 THEN 'number of values unknown' "
    "WHEN entropy_change IS NULL THEN 'one value holds nearly all rows of the earlier version'",
    "ks_approx": f"{_NUMERIC} WHEN ks IS NULL THEN 'not all of limits and quartiles known'",
    "psi": f"{_ABSENT} WHEN psi_label = 'not_applicable' THEN 'no index for the scale ' || a_statistical_scale WHEN psi_label = 'insufficient_data' THEN 'quartiles unknown'",
}
_FINDINGS = {
    "cv_drift": ("cv_change", "cv_severity", f"'Spread went from ' || {_PCT('cv_base')} || ' % to ' || {_PCT('cv_new')} || ' % of the mean.'"),
    "std_drift": ("std_change", "std_severity", f"'Spread ' || std_direction || ' by ' || {_PCT('std_change')} || ' %.'"),
    "quantile_shift": ("max_quantile_shift", "quantile_severity", f"worst_quantile || ' moved most, by ' || {_PCT('max_quantile_shift')} || ' % of the earlier interquartile range.'"),
    "boundary_drift": ("max_boundary_shift", "boundary_severity", f"'The lower limit moved by ' || {_PCT('lower_shift')} || ' %, the upper by ' || {_PCT('upper_shift')} || ' % of the earlier range.'"),
    "kurtosis_drift": (
        "kurtosis_delta", "kurtosis_severity",
        f"'Tails are ' || CASE WHEN kurtosis_delta > 0 THEN 'heavier' WHEN kurtosis_delta < 0 THEN 'lighter' ELSE 'as before' END || ', kurtosis by ' || {_PCT('kurtosis_delta')} || ' hundredths.'",
    ),
    "entropy_drift": ("entropy_change", "entropy_severity", f"'The mix of values changed its entropy by ' || {_PCT('entropy_change')} || ' %.'"),
    "ks_approx": ("ks", "ks_severity", f"'The distributions differ most at ' || ks_point || ', by ' || {_PCT('ks')} || ' % of the rows.'"),
    "psi": ("psi", "psi_label", f"'The index is ' || {_PCT('psi')} || ' hundredths.'"),
}
answer(
    "D14_metric_notes",
    "\nUNION ALL ".join(
        f"""SELECT {_P}, '{m}' AS metric, CASE WHEN why IS NULL THEN round({v}, 4) END AS value, CASE WHEN why IS NULL THEN {sev} END AS severity, why IS NULL AS applicable,
  coalesce(why, {text} || CASE {sev} WHEN 'stable' THEN ' No action.' WHEN 'notable' THEN ' Watch it.' WHEN 'monitor' THEN ' Watch it.'
    WHEN 'critical' THEN ' Look into it before scoring.' WHEN 'shift' THEN ' Look into it before scoring.' ELSE '' END) AS note
FROM (SELECT *, CASE {_REASONS[m]} END AS why FROM suite)"""
        for m, (v, sev, text) in _FINDINGS.items()
    ),
)
answer(
    "D13_baseline_drift",
    "SELECT table_name, column_name, to_idx AS pair_idx, to_ver, psi, psi_label, psi_applicable FROM pbs",
)
answer("D13_baseline_worst", "SELECT * FROM d13")
answer(
    "D14_all_metrics",
    f"""
SELECT {_P}, {_rounded('cv_change std_change max_quantile_shift max_boundary_shift kurtosis_delta entropy_change ks psi')},
  psi_label, cv_severity, std_severity, quantile_severity, boundary_severity, kurtosis_severity, entropy_severity, ks_severity
FROM suite
""",
)

# ── version comparison ──────────────────────────────────────────────────────────────────────────
answer("C0_verdict", "SELECT * FROM c0")
answer("C1_version_summary", "SELECT table_name, version, abt_name, row_count, col_count, ver_idx FROM vers")
answer("C1_pair_summary", "SELECT * EXCLUDE (n_worsened) FROM c1")
answer("C2_schema_changes", "SELECT * EXCLUDE (last_pair) REPLACE (round(completeness, 6) AS completeness) FROM c2")
answer(
    "C3_completeness_changes",
    """
SELECT table_name, pair_idx, from_ver, to_ver, column_name, round(b_completeness_percent - a_completeness_percent, 1) AS delta,
  CASE WHEN b_completeness_percent > a_completeness_percent THEN 'improved' ELSE 'regressed' END AS direction
FROM pp WHERE abs(b_completeness_percent - a_completeness_percent) >= 5
""",
)
answer("C3_completeness_series", "SELECT * REPLACE (round(first_comp, 6) AS first_comp, round(last_comp, 6) AS last_comp) FROM c3")
answer("C3p_missing_pattern", "SELECT table_name, missing_pattern, count(*) AS columns FROM c3 GROUP BY 1, 2")
answer("C4_drift_flags", "SELECT * FROM c4_flags")
answer("C4_distribution_drift", "SELECT * FROM c4")
answer(
    "C4s_version_stats",
    f"""
SELECT table_name, column_name, ver_idx, ver_name, {_rounded('mean std skewness min_val max_val')},
  has_outliers, n_outliers
FROM (SELECT * REPLACE (CASE WHEN data_type = 'num' THEN has_outliers END AS has_outliers,
                        CASE WHEN data_type = 'num' THEN n_outliers END AS n_outliers) FROM gridq)
WHERE z_type = 'num' AND z_scale NOT IN ('id', 'binary', 'unary') AND column_name <> 'target'
""",
)
answer("C5_target_rates", "SELECT * FROM c5_rates")
answer("C5_target_drift", "SELECT * FROM c5")
_V = "SELECT table_name, column_name, ver_idx, present"
answer("C3_completeness_values", f"{_V}, round(completeness_percent, 6) AS completeness_percent FROM gridq")
answer("C6_quality_values", f"{_V}, mismatched_count, blank_value_count FROM gridq SEMI JOIN c6 USING (table_name, column_name)")
answer("C7_statuses", f"{_V}, coalesce(status, 'absent') AS status FROM gridq")
answer("C9_scores", f"{_V}, score FROM gridq")
answer("C10_cardinalities", f"{_V}, cardinality_count FROM gridq")
answer("S11_caution_columns", "SELECT table_name, version, column_name, status FROM sc WHERE status = 'caution'")
answer("C6_quality_regression", "SELECT * FROM c6")
answer("C7_readiness_change", "SELECT * FROM c7")
answer("C8_psi_worst", "SELECT * FROM c8")
answer("C8_psi_summary", "SELECT * FROM c8s")
answer(
    "C8h_psi_heatmap",
    "SELECT table_name, column_name, pair_idx, psi FROM ppsi",
)
answer("C9_health_trend", "SELECT * EXCLUDE (first_version, first_seq) FROM c9")
answer("C9_dataset_trend", "SELECT * FROM c9d")
answer("C10_cardinality_drift", "SELECT * FROM c10")
_OVERVIEW = """
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY CASE worst_label WHEN 'shift' THEN 0 WHEN 'monitor' THEN 1
    WHEN 'stable' THEN 2 ELSE 3 END, CASE overall_severity WHEN 'critical' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END, column_name) AS overview_rank
FROM (SELECT table_name, column_name, worst_label, h.last_score, round(c.last_comp, 6) AS last_comp, missing_pattern, last_status,
        change_type, overall_severity,
        (SELECT count(*) FROM c10 e WHERE e.table_name = w.table_name AND e.column_name = w.column_name) > 0 AS cardinality_event
      FROM c8 w LEFT JOIN c9 h USING (table_name, column_name) LEFT JOIN c3 c USING (table_name, column_name)
        LEFT JOIN c7 USING (table_name, column_name) LEFT JOIN c4 USING (table_name, column_name))
"""
answer("C12_overview_matrix", _OVERVIEW)
answer("C12_name_search", f"SELECT table_name, column_name, worst_label, overview_rank FROM ({_OVERVIEW}) WHERE lower(column_name) LIKE '%id%'")
answer(
    "C13_quantile_trend",
    "\nUNION ALL ".join(
        f"SELECT table_name, column_name, ver_idx, '{k}' AS stat, round({v}, 4) AS value FROM gridq WHERE data_type = 'num' AND {v} IS NOT NULL"
        for k, v in {"max": "max_val", "q3": "q75", "median": "q50", "q1": "q25", "min": "min_val", "mean": "mean"}.items()
    ),
)
answer(
    "C13_ridge_density",
    "\nUNION ALL ".join(
        f"SELECT table_name, column_name, ver_idx, {i} AS bin, round({lo}, 4) AS lo, round({hi}, 4) AS hi, "
        f"round(0.25 / greatest({hi} - {lo}, 1e-9), 4) AS density FROM gridq WHERE q50 IS NOT NULL"
        for i, (lo, hi) in enumerate([("min_val", "q25"), ("q25", "q50"), ("q50", "q75"), ("q75", "max_val")])
    ),
)

# ── interpretations ─────────────────────────────────────────────────────────────────────────────
from oracle import interpret_sql  # noqa: E402,F401

answer("I1_feature_verdicts", f"SELECT {_G}, verdict, cause, effort, n_steps, verdict_rank FROM i1")
answer(
    "I1_ordered_steps",
    f"""
SELECT {_G}, step_seq, type, method, amount FROM i1_steps
WHERE ({_G}) IN (SELECT ({_G}) FROM i1 WHERE verdict = 'fix_then_use')
""",
)
answer("I2_training_readiness", "SELECT * REPLACE (round(completeness, 6) AS completeness) FROM i2")
answer(
    "I3_preprocessing_checklist",
    f"""
SELECT table_name, version, row_number() OVER (PARTITION BY table_name, version
    ORDER BY list_position(['quality_fix', 'imputation', 'outlier_cap', 'transformation'], type), seen_group, col_seq, step_seq) AS step_no,
  type, column_name, method, amount
FROM i1_steps JOIN (SELECT {_G}, seen_group, col_seq FROM i1 WHERE verdict = 'fix_then_use') USING ({_G})
""",
)
answer("S11_verdict_counts", "SELECT table_name, version, verdict, count(*) AS columns FROM i1 GROUP BY 1, 2, 3")
answer("I4_population_shift", "SELECT * FROM i4")
answer("I5_target_stability", "SELECT * FROM i5")
answer("I6_feature_impact", "SELECT * FROM i6")
answer("I7_model_action", "SELECT * FROM i7")
answer("I8_break_risks", "SELECT * FROM i8")
answer("I9_feed_health", "SELECT * EXCLUDE (first_gap) FROM i9")
answer(
    "I4b_population_history",
    """
SELECT table_name, shift_scope, refined_cause, trend_slope, trend_direction, dataset_scores
FROM i4c JOIN c9d USING (table_name) JOIN s0_history USING (table_name)
""",
)
answer(
    "I4b_drifted_score_history",
    """
SELECT table_name, column_name, ver_idx, ver_name, score FROM gridq
WHERE (table_name, column_name) IN (SELECT (table_name, column_name) FROM c4 WHERE overall_severity <> 'stable')
""",
)
answer(
    "I5b_target_history",
    """
SELECT table_name, drift_type, refined_drift_type, ver_idx, ver_name, event_rate FROM i5c LEFT JOIN c5_rates USING (table_name)
""",
)
answer(
    "I6b_feature_history",
    f"SELECT {_P}, drift_cause, drift_mechanism, from_ver, to_ver, psi, ppsi.psi_label FROM i6c JOIN ppsi USING (table_name, column_name) WHERE psi_applicable",
)
answer(
    "I7b_action_history",
    """
SELECT table_name, decision, refined_decision, drift_type, total_drift_pp, dataset_scores FROM i7c JOIN s0_history USING (table_name)
""",
)
answer("I8b_break_risks", "SELECT table_name, column_name, risk, severity, risk_rank FROM i8")
answer(
    "I9b_feed_history",
    "SELECT table_name, feed_health, pattern, failure_mode, dataset_scores FROM i9c JOIN s0_history USING (table_name)",
)
answer("I4c_population_refined", "SELECT table_name, sampling_signal, coordinated, v1_distance, refined_cause FROM i4c")
answer("I5c_target_refined", "SELECT table_name, drift_type, refined_drift_type FROM i5c")
answer("I6c_feature_refined", "SELECT table_name, column_name, drift_mechanism, median_abs, mean_delta, upper_abs, std_norm FROM i6c")
answer("I7c_action_refined", "SELECT table_name, decision, refined_decision, velocity_flag, unstable_count FROM i7c")
answer(
    "I8c_risk_priority",
    """
SELECT table_name, column_name, risk, severity, CASE WHEN risk IN ('type_mismatch', 'dropped_feature') THEN 'immediate_fix'
  WHEN severity = 'critical' THEN 'urgent' ELSE 'monitor' END AS priority FROM i8
""",
)
answer("I9c_failure_mode", "SELECT table_name, degrading_count, total_cols, failure_mode FROM i9c")

# ── signals, themes, cards ──────────────────────────────────────────────────────────────────────
from oracle import signal_sql  # noqa: E402,F401

_C = "table_name, column_name"
answer("C0_issues", "SELECT * FROM c0_issues")
answer("G1_metric_rows", "SELECT * FROM g1")
answer("G2_magnitude", f"SELECT {_C}, metric_type, is_private, magnitude FROM g2")
answer(
    "G3_column_signals",
    f"SELECT {_C}, metric_type, severity, magnitude, n_supporting, supporting FROM sig1 WHERE metric_type <> 'schema'",
)
answer("G4_root_cause", f"SELECT {_C}, metric_type, root_cause FROM sig1")
answer("G5_slot", f"SELECT {_C}, metric_type, slot, is_private FROM sig1")
answer("G6_direction", f"SELECT {_C}, metric_type, direction FROM sig1")
answer("G7_schema_signals", f"SELECT {_C}, severity, magnitude, direction, slot FROM sig1 WHERE metric_type = 'schema'")
answer("G8_private_columns", "SELECT * FROM private_cols")
answer("G9_signals", f"SELECT {_C}, metric_type, severity, magnitude, root_cause, direction, slot, signal_rank FROM sig1")
answer(
    "G10_slot_severity",
    """
SELECT table_name, slot, count(*) AS signals, bool_or(severity = 'critical') AS has_critical, bool_or(severity = 'notable') AS has_notable
FROM sig1 GROUP BY 1, 2
""",
)
answer("G10_top_population", f"SELECT {_C}, slot_rank, magnitude FROM pop WHERE slot = 'population' AND slot_rank <= 3")
_FACTS = (
    "psi mean_before mean_after mean_delta mean_delta_pct completeness_before completeness_after q1_shift median_shift q3_shift "
    "iqr_base min_base min_new max_base max_new upper_shift lower_shift std_base std_new std_change cv_base cv_new cv_change "
    "baseline_psi fsi fsi_mean_psi velocity"
)
answer(
    "G11_raw_facts",
    f"SELECT {_C}, {_rounded(_FACTS)}, psi_label, psi_worst_pair, worst_quantile, baseline_label, fsi_label, velocity_label FROM facts",
)
answer("G12_composite_importance", "SELECT * FROM composites")
answer("G13_signals_composite", f"SELECT {_C}, metric_type, severity, magnitude, slot, signal_rank FROM sig2")
answer("G14_rule_signals", "SELECT * FROM rules")
answer("H1_signal_themes", f"SELECT {_C}, metric_type, theme_id FROM themed")
answer("H2_theme_groups", "SELECT table_name, theme_id, theme_rank, n_columns, max_importance, worst_column, columns FROM theme_groups")
_THEME = (
    "worst_psi worst_mean_delta_pct mean_before mean_after worst_median_shift worst_q1_shift worst_q3_shift iqr_base min_base min_new "
    "max_base max_new std_base std_new worst_std_change completeness_before completeness_after baseline_psi worst_velocity worst_fsi"
)
answer(
    "H3_theme_facts",
    f"SELECT table_name, theme_id, {_rounded(_THEME)}, worst_psi_label, worst_psi_pair, baseline_label, fsi_label FROM theme_groups",
)
# the wording is one table of the library, compared as data
_LABELS = {k: (vocab.THEME_DOMAINS[k], label) for k, label in vocab.THEME_LABELS.items()}
_DOMAIN = "CASE theme_id " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _LABELS.items()) + " END"
_TITLE = "CASE theme_id " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _LABELS.items()) + " END"
answer("H4_theme_domain", f"SELECT table_name, theme_id, {_DOMAIN} AS theme_domain, {_TITLE} AS theme_label FROM theme_groups")
_LINES = [
    "worst_psi", "mean_before + mean_after", "worst_median_shift", "worst_q1_shift", "worst_q3_shift", "max_base + max_new",
    "worst_std_change + std_base", "completeness_before + completeness_after", "baseline_psi", "worst_velocity", "worst_fsi",
]
answer(
    "H5_fact_sheet",
    "SELECT table_name, theme_id, 2 + " + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in _LINES) + " AS n_lines FROM theme_groups",
)
answer(
    "B1_theme_cards",
    f"""
SELECT table_name, theme_rank, theme_id, {_DOMAIN} AS theme_domain, {_TITLE} AS headline,
  CASE worst_severity WHEN 'critical' THEN 'critical' WHEN 'notable' THEN 'high' ELSE 'medium' END AS severity, decision, worst_psi AS psi, n_columns
FROM theme_groups JOIN i7 USING (table_name) WHERE theme_rank <= 5
""",
)
answer("B2_fallback_cards", "SELECT * FROM rules WHERE rule_rank <= 5")
answer("B3_root_cause_analysis", f"SELECT {_C}, metric_type, drift_cause, drift_cause <> 'data_loss' AS is_real_drift FROM b3")
answer("B4_evidence_rows", f"SELECT {_C}, drift_cause, n_evidence, first_label FROM b4")
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_by_cause = lambda words: "CASE drift_cause " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in words.items()) + " END"
answer(
    "B5_headline_causes",
    f"""SELECT table_name, story_slot AS slot, drift_cause,
  {_quoted(vocab.STAGE_CONTEXT["back_testing"] + ", ")} || {_by_cause(cards.STORY_HEADLINES)} || CASE WHEN rag = 'critical' THEN ', materially' ELSE ', noticeably' END AS headline,
  {_quoted(vocab.STAGE_ACTION["back_testing"] + ": ")} || {_by_cause(cards.STORY_ACTIONS)} AS impact_and_action FROM stories""",
)
answer("B6_drift_stories", f"SELECT {_C}, story_slot AS slot, rag AS severity, metric_type, drift_cause, magnitude FROM stories")
for _key, _step in [("B7_target_card", "b7"), ("B8_feed_card", "b8"), ("B9_model_risk_card", "b9"), ("B10_governance_card", "b10")]:
    answer(_key, f"SELECT table_name, slot, severity, n_evidence FROM {_step}")
answer("B11_card_order", "SELECT table_name, slot, severity, card_order FROM card_list")
answer(
    "B12_decision_view",
    "SELECT table_name, slot, severity, n_evidence, decision, urgency FROM card_list JOIN i7 USING (table_name)",
)
answer("V1_card_validation", "SELECT * FROM v1")
answer(
    "N2_story_facts",
    f"""
SELECT {_C}, slot_rank, metric_type, drift_cause, root_cause, card_from, card_to,
  {_rounded('psi mean_before mean_after mean_delta median_shift upper_shift lower_shift std_change completeness_before completeness_after')}
FROM stories
""",
)
_S = "replace({0}, '_', ' ')"
answer(
    "N1_narratives",
    f"""
SELECT table_name, CAST(version AS VARCHAR) AS subject, 'S0' AS section,
  'readiness ' || format('{{:.1f}}', score) || ' of 100, ' || {_S.format('readiness_label')} || ', blocked ' || blocked_cols AS sentence FROM s0l
UNION ALL SELECT table_name, CAST(version AS VARCHAR), 'S6', 'event rate ' || coalesce(format('{{:.2f}}', event_rate), 'n/a') || '%, ' || coalesce(balance_label, 'n/a') FROM s6
UNION ALL SELECT table_name, 'table', 'C0', 'verdict ' || {_S.format('verdict')} || ', issues ' || issue_count FROM c0
UNION ALL SELECT table_name, 'table', 'C8', 'shifted ' || shift_count || ', to watch ' || monitor_count || ', stable ' || stable_count FROM c8s
UNION ALL SELECT table_name, 'table', 'versions', 'score ' || format('{{:.1f}}', first_score) || ' to ' || format('{{:.1f}}', last_score) || ', ' || {_S.format('trend_direction')} FROM c9d
UNION ALL SELECT table_name, 'table', 'I4b', drifted_count || ' of ' || total_features || ' features drifted, ' || {_S.format('refined_cause')} FROM i4c
UNION ALL SELECT table_name, 'table', 'I5b', 'target moved ' || format('{{:+.2f}}', total_drift_pp) || 'pp, ' || {_S.format('drift_type')} FROM i5 WHERE target_found
UNION ALL SELECT table_name, column_name, 'I6b', {_S.format('drift_cause')} || ', PSI ' || coalesce(format('{{:.4f}}', last_psi), 'n/a') FROM i6
UNION ALL SELECT table_name, 'table', 'I7b', {_S.format('refined_decision')} || ', urgency ' || {_S.format('urgency')}
  FROM (SELECT i7c.table_name, refined_decision, urgency FROM i7c JOIN i7 ON i7c.table_name = i7.table_name)
UNION ALL SELECT table_name, 'table', 'I9b', 'feeds ' || feed_health || ', ' || {_S.format('failure_mode')} FROM i9c
""",
)

# ── payloads, registry, store ───────────────────────────────────────────────────────────────────
answer(
    "R8_json_profiles",
    f"""
SELECT {_G}, row_count, row_number() OVER (PARTITION BY table_name, version ORDER BY col_seq) - 1 AS col_seq, data_type,
  statistical_scale, missing_count, cardinality_count, has_outliers, n_outliers, blank_value_count, mismatched_count, information_privacy, has_unique_field, {_rounded('completeness_percent mean std q25 q50 q75')}
FROM prof
""",
)
answer(
    "R9_double_encoded",
    f"""
SELECT {_G}, row_number() OVER (PARTITION BY table_name, version ORDER BY col_seq) - 1 AS col_seq, {_rounded('completeness_percent')},
  cardinality_count, statistical_scale FROM prof
""",
)
answer(
    "R10_content_hash",
    "SELECT table_name, 2 * count(*) AS documents, count(*) AS distinct_hashes, 64 AS digits FROM vers GROUP BY table_name",
)
answer(
    "R11_registry_ingest",
    """
SELECT table_name, ver_idx + 1 AS arrival, ver_idx + 1 AS version, CASE ver_idx WHEN 0 THEN 'registered' ELSE 'version_added' END AS action FROM vers
UNION ALL SELECT table_name, 1000, 1, 'unchanged' FROM vers WHERE ver_idx = 0
""",
)
answer("R12_snapshot_fallback", "SELECT table_name, version, 77 AS row_count, table_name AS abt_name, false AS measured FROM vers")
answer(
    "R11_second_batch",
    """
SELECT table_name, ver_idx + 1 AS arrival, ver_idx + 1 AS version, CASE WHEN ver_idx < 2 THEN 'unchanged' ELSE 'version_added' END AS action FROM vers
""",
)
answer("R13_resolve", "SELECT table_name, ver_idx + 1 AS version, row_count FROM vers WHERE table_name = 'abt_orders' AND ver_idx = 1")
answer(
    "R13_list_tables",
    "SELECT table_name, count(*) AS version_count, string_agg(CAST(ver_idx + 1 AS VARCHAR), ',' ORDER BY ver_idx) AS versions FROM vers GROUP BY 1",
)
answer("R13_table_versions", "SELECT table_name, ver_idx + 1 AS version, row_count FROM vers WHERE table_name = 'abt_orders'")
answer(
    "R14_version_load",
    "SELECT table_name, version, column_name, row_count, missing_count, cardinality_count FROM prof WHERE table_name = 'abt_orders' AND version = 2000",
)
answer("K2_version_store", "SELECT table_name, version, count(*) AS columns, CAST(sum(missing_count) AS BIGINT) AS missing_cells FROM prof GROUP BY 1, 2")

# ── exact drift from rows ───────────────────────────────────────────────────────────────────────
from oracle import exact_sql  # noqa: E402,F401

answer("D6x_entropy_exact", f"SELECT {_P}, {_rounded('entropy_base entropy_new entropy_change')}, severity FROM d6x")
answer("D7x_ks_exact", f"SELECT {_P}, {_rounded('ks', 6)}, severity FROM d7x")
answer("D8x_psi_exact", f"SELECT {_P}, {_rounded('psi', 6)}, psi_label FROM d8x")
answer("D8x_psi_deciles", f"SELECT {_P}, 10 AS bins, {_rounded('psi', 6)}, psi_label FROM d8d")
answer("D9x_psi_categorical_exact", f"SELECT {_P}, {_rounded('psi', 6)}, categories, psi_label FROM d9x")

# ── streaming ───────────────────────────────────────────────────────────────────────────────────
answer(
    "M1_windowed_profile",
    """
SELECT 'events' AS table_name, strftime(ts, '%Y-%m-%d') AS day, column_name, count(*) AS row_count, count(v) AS n_present,
  min(v) AS min_val, max(v) AS max_val, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std
FROM (SELECT ts, 'user_id' AS column_name, CAST(user_id AS DOUBLE) AS v FROM events
      UNION ALL SELECT ts, 'event_id', CAST(event_id AS DOUBLE) FROM events
      UNION ALL SELECT ts, 'value', value FROM events) t
GROUP BY 2, 3
""",
)
answer(
    "R3_sketch_profile",
    f"""
SELECT p.table_name, p.version, p.column_name, row_count, missing_count, {_rounded('min_val max_val mean')}, true AS quartiles_near, true AS distinct_near,
  round(x.mode_num, 4) AS mode_num, x.mode_txt, round(x.rarest_num, 4) AS rarest_num, x.rarest_txt
FROM prof p LEFT JOIN (
  SELECT {_G}, max(CASE WHEN hi = 1 THEN num END) AS mode_num, max(CASE WHEN hi = 1 THEN txt END) AS mode_txt,
    max(CASE WHEN lo = 1 THEN num END) AS rarest_num, max(CASE WHEN lo = 1 THEN txt END) AS rarest_txt
  FROM (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY cnt DESC, num, txt) AS hi, row_number() OVER (PARTITION BY {_G} ORDER BY cnt, num, txt) AS lo
        FROM (SELECT {_G}, num, txt, count(*) AS cnt FROM cells WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY ALL))
  GROUP BY {_G} HAVING count(*) < 256) x
  ON x.table_name = p.table_name AND x.version IS NOT DISTINCT FROM p.version AND x.column_name = p.column_name
""",
)
answer(
    "R7_declared_types",
    """
WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS version, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
    CASE WHEN o_orderkey % 11 = 0 THEN 'EUR ' || o_orderkey WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS number
  FROM orders),
c AS (SELECT version, 'day' AS column_name, day AS v, TRY_CAST(day AS DATE) IS NULL AS wrong FROM o
  UNION ALL SELECT version, 'number', number, TRY_CAST(number AS BIGINT) IS NULL FROM o
  UNION ALL SELECT version, 'priority', priority, TRY_CAST(priority AS INTEGER) IS NULL OR NOT regexp_matches(priority, '^[1-5]-.*$') FROM o)
SELECT 'orders' AS table_name, version, column_name, count(*) AS row_count, count(CASE WHEN trim(v) = '' THEN 1 END) AS blank_value_count,
  count(CASE WHEN trim(v) <> '' AND wrong THEN 1 END) AS mismatched_count
FROM c GROUP BY version, column_name
""",
)
answer(
    "R15_catalog_rollup",
    """
SELECT table_name, version, CAST(GROUPING_ID(table_name, version) AS INTEGER) AS level, count(*) AS columns, CAST(sum(row_count) AS BIGINT) AS cells,
  CAST(sum(missing_count) AS BIGINT) AS missing_cells, round(100.0 * (1 - sum(missing_count)::DOUBLE / sum(row_count)), 4) AS completeness_percent,
  min(score) AS worst_score, count(CASE WHEN status = 'ready' THEN 1 END) AS n_ready, count(CASE WHEN status = 'caution' THEN 1 END) AS n_caution,
  count(CASE WHEN status = 'drop' THEN 1 END) AS n_drop
FROM sc GROUP BY ROLLUP (table_name, version)
""",
)
answer(
    "R11_two_writers",
    """
SELECT table_name, ver_idx + 1 AS version, row_count, CASE WHEN ver_idx < 2 THEN '2024-01-01' ELSE '2024-01-02' END AS created, '2024-01-02' AS seen,
  2 AS commits, true AS refused
FROM vers WHERE ver_idx < 3
""",
)
answer(
    "R1_incremental_profile",
    f"""
SELECT {_G}, row_count, missing_count, {_rounded('min_val max_val mean std skewness kurtosis')}, blank_value_count, mismatched_count,
  chars_max_count, chars_min_count, true AS distinct_near FROM prof
""",
)
answer(
    "M1_weekly_rollup",
    """
SELECT 'events' AS table_name, version, column_name, count(*) AS row_count, count(v) AS n_present, min(v) AS min_val, max(v) AS max_val,
  round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, CAST(sum(blank) AS BIGINT) AS n_blank
FROM (SELECT version, 'user_id' AS column_name, CAST(user_id AS DOUBLE) AS v, NULL AS blank FROM event_rows
  UNION ALL SELECT version, 'event_id', CAST(event_id AS DOUBLE), NULL FROM event_rows
  UNION ALL SELECT version, 'value', value, NULL FROM event_rows
  UNION ALL SELECT version, 'event_type', length(event_type), CASE WHEN trim(event_type) = '' THEN 1 WHEN event_type IS NOT NULL THEN 0 END FROM event_rows
  UNION ALL SELECT version, 'props', length(props), CASE WHEN trim(props) = '' THEN 1 WHEN props IS NOT NULL THEN 0 END FROM event_rows) t
GROUP BY version, column_name
""",
)
