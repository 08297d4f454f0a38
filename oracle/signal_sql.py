"""Signal, theme and card steps."""

from oracle import step

_T = "('target', 'bad', 'default', 'event', 'flag', 'label', 'y')"
_SUITE = f"in_z AND z_scale NOT IN ('id', 'unary') AND lower(column_name) NOT IN {_T}"
_MEASURE = f"z_type = 'num' AND z_scale NOT IN ('id', 'binary', 'unary') AND lower(column_name) NOT IN {_T}"
TIES = ["schema", "psi", "mean_shift", "missingness", "cardinality", "quantile_shift", "boundary", "std", "kurtosis", "entropy"]
_TIE = "list_position([" + ", ".join(f"'{t}'" for t in TIES) + "], metric_type)"

step(
    "c0_issues",
    """
SELECT c5.table_name, c0.verdict, 'target_' || severity AS issue, CAST(delta_pp AS DOUBLE) AS measure, from_ver, to_ver
FROM c5 JOIN c0 ON c5.table_name = c0.table_name WHERE c5.back_test_required
UNION ALL SELECT table_name, verdict, 'shifted_features', shift_count, NULL, NULL FROM c0 WHERE shift_count > 0
UNION ALL SELECT c1.table_name, c0.verdict, 'readiness_degraded', n_worsened, from_ver, to_ver
  FROM c1 JOIN c0 ON c1.table_name = c0.table_name WHERE n_worsened >= 2
UNION ALL SELECT table_name, verdict, CASE WHEN verdict = 'BLOCK' THEN 'dataset_not_ready' WHEN last_score < first_score - 15 THEN 'dataset_declined'
    ELSE 'dataset_slipping' END, last_score, NULL, NULL
  FROM c0 WHERE verdict = 'BLOCK' OR last_score < first_score - 15 OR (last_score < first_score - 8 AND NOT back_test_required)
""",
)
step(
    "private_cols",
    "SELECT table_name, column_name, bool_or(g_privacy) AS is_private FROM sc GROUP BY table_name, column_name",
)
step(
    "last_pm",
    f"""
SELECT table_name, column_name, CASE WHEN {_MEASURE} AND a_data_type = 'num' THEN a_mean END AS mean_before,
  CASE WHEN {_MEASURE} AND b_data_type = 'num' THEN b_mean END AS mean_after,
  a_completeness_percent AS completeness_before, b_completeness_percent AS completeness_after FROM pm WHERE last_pair
""",
)
step(
    "last_sm",
    f"""
SELECT table_name, column_name, psi_label AS latest_label, round(q1_shift, 4) AS q1_shift, round(median_shift, 4) AS median_shift,
  round(q3_shift, 4) AS q3_shift, round(iqr_base, 4) AS iqr_base, worst_quantile,
  CASE WHEN lower_shift IS NOT NULL THEN a_min_val END AS min_base, CASE WHEN lower_shift IS NOT NULL THEN a_max_val END AS max_base,
  CASE WHEN lower_shift IS NOT NULL THEN b_min_val END AS min_new, CASE WHEN lower_shift IS NOT NULL THEN b_max_val END AS max_new,
  round(upper_shift, 4) AS upper_shift, round(lower_shift, 4) AS lower_shift, round(std_change, 4) AS std_change,
  round(cv_base, 4) AS cv_base, round(cv_new, 4) AS cv_new, round(cv_change, 4) AS cv_change,
  CASE WHEN std_change IS NOT NULL THEN round(a_std, 4) END AS std_base, CASE WHEN std_change IS NOT NULL THEN round(b_std, 4) END AS std_new,
  quantile_severity, boundary_severity, std_severity, kurtosis_severity FROM pm WHERE last_pair AND {_SUITE}
""",
)
step(
    "worst_pair",
    """
SELECT * FROM (SELECT table_name, column_name, psi, psi_label, from_ver || '→' || to_ver AS psi_worst_pair,
    row_number() OVER (PARTITION BY table_name, column_name ORDER BY psi DESC, pair_idx) AS rn FROM ppsi WHERE psi_applicable) t WHERE rn = 1
""",
)
step(
    "far_pair",
    """
SELECT * FROM (SELECT table_name, column_name, psi AS baseline_psi, psi_label AS baseline_label,
    row_number() OVER (PARTITION BY table_name, column_name ORDER BY to_idx DESC) AS rn FROM pbs) t WHERE rn = 1
""",
)
step(
    "card_events",
    """
SELECT table_name, column_name, max(CASE severity WHEN 'critical' THEN 2 WHEN 'notable' THEN 1 ELSE 0 END) AS card_rank,
  arg_max(severity, pair_idx) = 'dropped' AS card_dropped, last(from_card ORDER BY pair_idx) AS card_from,
  last(to_card ORDER BY pair_idx) AS card_to FROM c10 GROUP BY table_name, column_name
""",
)
step(
    "facts",
    """
SELECT w.table_name, w.column_name, w.first_version, w.first_seq, wp.psi, coalesce(wp.psi_label, s.latest_label) AS psi_label,
  wp.psi_worst_pair, l.mean_before, l.mean_after, round(l.mean_after - l.mean_before, 4) AS mean_delta,
  CASE WHEN abs(l.mean_before) > 1e-9 THEN round((l.mean_after - l.mean_before) / abs(l.mean_before) * 100, 2) END AS mean_delta_pct,
  l.completeness_before, l.completeness_after, s.* EXCLUDE (table_name, column_name, latest_label),
  f.baseline_psi, f.baseline_label, d.fsi, d.fsi_label, round(d.mean_psi, 4) AS fsi_mean_psi, d.velocity, d.velocity_label,
  c3.missing_pattern, c4.overall_severity, c4.last_mean_delta, c4.flag_count, e.card_rank, e.card_dropped, e.card_from, e.card_to,
  coalesce(p.is_private, false) AS is_private
FROM c8 w
  LEFT JOIN worst_pair wp ON wp.table_name = w.table_name AND wp.column_name = w.column_name
  LEFT JOIN last_pm l ON l.table_name = w.table_name AND l.column_name = w.column_name
  LEFT JOIN last_sm s ON s.table_name = w.table_name AND s.column_name = w.column_name
  LEFT JOIN far_pair f ON f.table_name = w.table_name AND f.column_name = w.column_name
  LEFT JOIN d11 d ON d.table_name = w.table_name AND d.column_name = w.column_name
  LEFT JOIN c3 ON c3.table_name = w.table_name AND c3.column_name = w.column_name
  LEFT JOIN c4 ON c4.table_name = w.table_name AND c4.column_name = w.column_name
  LEFT JOIN card_events e ON e.table_name = w.table_name AND e.column_name = w.column_name
  LEFT JOIN private_cols p ON p.table_name = w.table_name AND p.column_name = w.column_name
""",
)
_FREE = f"lower(column_name) NOT IN {_T}"
step(
    "g1",
    f"""
SELECT table_name, column_name, 'psi' AS metric_type, CASE psi_label WHEN 'shift' THEN 'critical' ELSE 'notable' END AS severity
  FROM facts WHERE {_FREE} AND psi_label IN ('shift', 'monitor')
UNION ALL SELECT table_name, column_name, 'mean_shift', overall_severity FROM facts WHERE flag_count > 0 AND overall_severity <> 'stable'
UNION ALL SELECT table_name, column_name, 'missingness', CASE missing_pattern WHEN 'sparse' THEN 'notable' ELSE 'critical' END FROM facts
  WHERE {_FREE} AND missing_pattern IN ('growing_missing', 'newly_missing', 'sparse')
UNION ALL SELECT table_name, column_name, 'cardinality', CASE card_rank WHEN 2 THEN 'critical' ELSE 'notable' END FROM facts WHERE card_rank IS NOT NULL
UNION ALL SELECT table_name, column_name, 'quantile_shift', quantile_severity FROM facts WHERE quantile_severity <> 'stable'
UNION ALL SELECT table_name, column_name, 'boundary', boundary_severity FROM facts WHERE boundary_severity <> 'stable'
UNION ALL SELECT table_name, column_name, 'std', std_severity FROM facts WHERE std_severity <> 'stable'
UNION ALL SELECT table_name, column_name, 'kurtosis', kurtosis_severity FROM facts WHERE kurtosis_severity <> 'stable'
""",
)
step(
    "weights",
    """
SELECT * FROM (VALUES ('schema', 0.95::DOUBLE), ('psi', 1.0::DOUBLE), ('mean_shift', 0.85::DOUBLE), ('missingness', 0.8::DOUBLE),
  ('quantile_shift', 0.75::DOUBLE), ('cardinality', 0.7::DOUBLE), ('boundary', 0.65::DOUBLE), ('std', 0.55::DOUBLE),
  ('kurtosis', 0.45::DOUBLE)) AS t(metric_type, mw)
""",
)
step(
    "g2",
    """
SELECT g1.*, is_private, round(least(1, CASE severity WHEN 'critical' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * mw
    * CASE WHEN is_private THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END), 4) AS magnitude
FROM g1 JOIN weights USING (metric_type) JOIN facts USING (table_name, column_name)
""",
)
step(
    "composites",
    """
SELECT table_name, column_name, round(least(1, (0.5 * least(coalesce(psi, 0) / 0.5, 1) + 0.3::DOUBLE * least(abs(coalesce(mean_delta_pct, 0)) / 30, 1)
    + 0.2::DOUBLE * least(greatest(abs(coalesce(q1_shift, 0)), abs(coalesce(median_shift, 0)), abs(coalesce(q3_shift, 0))), 1))
    * CASE WHEN is_private THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END), 4) AS importance FROM facts
""",
)


def _signals(name: str, adjusted: str) -> None:
    step(
        f"{name}_scored",
        f"""
SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY adj DESC, {_TIE}) AS metric_no
FROM (SELECT g2.table_name, g2.column_name, g2.metric_type, g2.severity, {adjusted} AS adj
  FROM g2 JOIN facts f ON f.table_name = g2.table_name AND f.column_name = g2.column_name
    JOIN composites k ON k.table_name = g2.table_name AND k.column_name = g2.column_name
    LEFT JOIN (SELECT table_name, column_name FROM g1 WHERE metric_type = 'psi') hp
      ON hp.table_name = g2.table_name AND hp.column_name = g2.column_name) t
""",
    )
    step(
        name,
        f"""
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY magnitude DESC, {_TIE}, first_version, first_seq) AS signal_rank
FROM (SELECT s.table_name, s.column_name, s.metric_type, s.severity, s.adj AS magnitude, root_cause,
    CASE WHEN s.metric_type = 'mean_shift' THEN CASE WHEN coalesce(last_mean_delta, 0) > 0 THEN 'up' ELSE 'down' END
      WHEN s.metric_type = 'psi' THEN 'shift' WHEN s.metric_type = 'missingness' THEN 'down'
      WHEN s.metric_type = 'cardinality' THEN CASE WHEN card_dropped THEN 'dropped' ELSE 'expand' END
      WHEN s.metric_type = 'boundary' THEN CASE WHEN upper_shift > 0 OR lower_shift < 0 THEN 'expand' ELSE 'contract' END
      WHEN s.metric_type = 'std' THEN CASE WHEN std_new > std_base THEN 'expand' ELSE 'contract' END ELSE 'mixed' END AS direction,
    CASE WHEN is_private THEN 'governance' WHEN root_cause = 'pipeline_issue' OR s.metric_type = 'missingness' THEN 'pipeline'
      ELSE 'population' END AS slot, is_private, first_version, first_seq, supporting, n_supporting
  FROM (SELECT x.*, CASE WHEN x.metric_type = 'missingness' OR f.missing_pattern IN ('growing_missing', 'newly_missing', 'sparse') THEN 'pipeline_issue'
          WHEN abs(i4.row_delta_pct) > 20 THEN 'sampling_change' WHEN i4.likely_cause = 'organic_population_change' THEN 'organic_shift'
          WHEN i4.likely_cause = 'sampling_change' THEN 'sampling_change' ELSE 'unknown' END AS root_cause,
        f.last_mean_delta, f.card_dropped, f.upper_shift, f.lower_shift, f.std_new, f.std_base, f.is_private, f.first_version, f.first_seq,
        (SELECT coalesce(string_agg(y.metric_type, ',' ORDER BY y.metric_no), '') FROM {name}_scored y
          WHERE y.table_name = x.table_name AND y.column_name = x.column_name AND y.metric_no > 1) AS supporting,
        (SELECT count(*) FROM {name}_scored y WHERE y.table_name = x.table_name AND y.column_name = x.column_name AND y.metric_no > 1) AS n_supporting
      FROM {name}_scored x JOIN facts f ON f.table_name = x.table_name AND f.column_name = x.column_name
        JOIN i4 ON i4.table_name = x.table_name WHERE x.metric_no = 1) s
  UNION ALL
  SELECT c2.table_name, c2.column_name, 'schema', 'critical',
    round(least(1, 0.95::DOUBLE * CASE WHEN is_private THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END), 4), 'schema_event',
    CASE change WHEN 'dropped' THEN 'dropped' ELSE 'mixed' END, CASE WHEN is_private THEN 'governance' ELSE 'model_risk' END,
    is_private, first_version, first_seq, '', 0
  FROM c2 JOIN facts f ON f.table_name = c2.table_name AND f.column_name = c2.column_name WHERE last_pair AND change <> 'added') u
""",
    )


_QUIET = "hp.column_name IS NOT NULL AND f.psi <= 0.1::DOUBLE"
_signals(
    "sig1",
    f"""CASE WHEN g2.metric_type = 'psi' THEN CASE WHEN f.psi > 0.1::DOUBLE
      THEN round(least(1, g2.magnitude * least(4, f.psi / 0.25)), 4) ELSE round(g2.magnitude * 0.1::DOUBLE, 4) END
    WHEN {_QUIET} THEN round(g2.magnitude * 0.25, 4) ELSE g2.magnitude END""",
)
_signals(
    "sig2",
    f"""CASE WHEN g2.metric_type IN ('psi', 'mean_shift', 'quantile_shift', 'boundary', 'std') THEN k.importance
    WHEN {_QUIET} THEN round(g2.magnitude * 0.25, 4) ELSE g2.magnitude END""",
)
step(
    "pop",
    """
SELECT *, row_number() OVER (PARTITION BY table_name, slot ORDER BY signal_rank) AS slot_rank FROM sig1
""",
)
SOURCES = [
    "c0_verdict", "i7_model_action", "i7_drift_velocity", "i7_fsi_unstable", "i5_target_stability",
    "i4_population_shift", "i6_feature_drift", "i6_data_loss_psi", "c8_psi_matrix", "i8_pipeline_break",
    "i9_pipeline_health", "c0_clear",
]
step(
    "rules_raw",
    """
SELECT table_name, 'c0_verdict' AS source, 'population' AS domain, CASE verdict WHEN 'BLOCK' THEN 'critical' ELSE 'high' END AS severity,
  issue AS cause, NULL::VARCHAR AS column_name, NULL::DOUBLE AS psi FROM c0_issues WHERE verdict IN ('BLOCK', 'BACK_TEST_REQUIRED')
UNION ALL SELECT table_name, 'i7_model_action', 'population', CASE urgency WHEN 'immediate' THEN 'critical' WHEN 'next_cycle' THEN 'high'
  WHEN 'pipeline_fix_first' THEN 'medium' ELSE 'low' END, 'drift_or_label_change', NULL, NULL FROM i7
  WHERE decision <> 'hold' OR urgency = 'pipeline_fix_first'
UNION ALL SELECT table_name, 'i7_drift_velocity', 'feature', 'high', 'accelerating_drift', column_name, NULL FROM d11 WHERE velocity > 0.05::DOUBLE
UNION ALL SELECT table_name, 'i7_fsi_unstable', 'feature', 'medium', 'chronic_instability', column_name, NULL FROM d11 WHERE fsi < 0.4::DOUBLE
UNION ALL SELECT table_name, 'i5_target_stability', 'target', CASE WHEN drift_type = 'label_change' THEN 'critical'
  WHEN drift_type IN ('organic_jump', 'data_loss') THEN 'high' ELSE 'medium' END, drift_type, target_column, NULL FROM i5
  WHERE target_found AND drift_type <> 'stable'
UNION ALL SELECT table_name, 'i4_population_shift', 'population', CASE WHEN shift_scope = 'broad' AND v1_distance = 'far' THEN 'critical'
  WHEN shift_scope = 'broad' THEN 'high' ELSE 'medium' END, likely_cause, NULL, NULL FROM i4 WHERE shift_scope IN ('broad', 'narrow')
UNION ALL SELECT table_name, 'i6_feature_drift', 'feature', CASE psi_label WHEN 'shift' THEN 'critical' ELSE 'medium' END, drift_cause, column_name, NULL
  FROM i6 WHERE is_real_drift
UNION ALL SELECT table_name, 'i6_data_loss_psi', 'pipeline', 'medium', 'data_loss', column_name, NULL FROM i6 WHERE NOT is_real_drift
UNION ALL SELECT table_name, 'i8_pipeline_break', 'pipeline', CASE severity WHEN 'critical' THEN 'critical' ELSE 'high' END, risk, column_name, NULL FROM i8
UNION ALL SELECT table_name, 'i9_pipeline_health', 'pipeline', CASE WHEN escalate THEN 'critical' ELSE 'high' END, 'pipeline_degradation', NULL, NULL
  FROM i9 WHERE feed_health = 'degrading'
""",
)
step(
    "rules",
    f"""
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity),
    coalesce(psi, 0) DESC, list_position([{', '.join(repr(s) for s in SOURCES)}], source), coalesce(column_name, ''), cause) AS rule_rank
FROM (SELECT * FROM rules_raw UNION ALL
  SELECT table_name, 'c0_clear', 'population', 'low', 'none', NULL, NULL FROM c0 WHERE table_name NOT IN (SELECT table_name FROM rules_raw)) t
""",
)
step(
    "themed",
    """
SELECT s.table_name, s.column_name, s.metric_type, s.severity, s.magnitude, s.signal_rank, f.* EXCLUDE (table_name, column_name),
  CASE WHEN s.metric_type IN ('schema', 'missingness') OR s.root_cause = 'pipeline_issue' THEN 'pipeline_failure'
    WHEN s.metric_type = 'cardinality' THEN 'new_segments' WHEN abs(f.velocity) > 0.1::DOUBLE OR f.fsi < 0.4::DOUBLE THEN 'volatility'
    WHEN s.metric_type = 'boundary' THEN 'boundary_expansion' WHEN s.metric_type = 'std' THEN 'spread_change'
    WHEN s.direction = 'down' THEN 'center_shift_down' WHEN s.direction = 'up' THEN 'center_shift_up'
    WHEN f.mean_delta_pct >= 0 THEN 'center_shift_up' ELSE 'center_shift_down' END AS theme_id
FROM sig2 s LEFT JOIN facts f ON s.table_name = f.table_name AND s.column_name = f.column_name AND s.metric_type <> 'schema'
""",
)


def _wide(field: str) -> str:
    return (
        f"(list({field} ORDER BY abs({field}) DESC, signal_rank) FILTER (WHERE {field} IS NOT NULL))[1]"
    )


def _top(field: str) -> str:
    return f"first({field} ORDER BY signal_rank)"


step(
    "theme_groups",
    f"""
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY max_importance DESC, first_rank) AS theme_rank
FROM (SELECT table_name, theme_id, min(signal_rank) AS first_rank, count(*) AS n_columns, max(magnitude) AS max_importance,
    string_agg(column_name, ',' ORDER BY signal_rank) AS columns, {_top('column_name')} AS worst_column, {_top('severity')} AS worst_severity,
    max(psi) AS worst_psi, {_top('psi_label')} AS worst_psi_label, {_top('psi_worst_pair')} AS worst_psi_pair,
    {_wide('mean_delta_pct')} AS worst_mean_delta_pct,
    (list(mean_before ORDER BY abs(mean_delta_pct) DESC, signal_rank) FILTER (WHERE mean_delta_pct IS NOT NULL))[1] AS mean_before,
    (list(mean_after ORDER BY abs(mean_delta_pct) DESC, signal_rank) FILTER (WHERE mean_delta_pct IS NOT NULL))[1] AS mean_after,
    {_wide('median_shift')} AS worst_median_shift, {_wide('q1_shift')} AS worst_q1_shift, {_wide('q3_shift')} AS worst_q3_shift,
    (list(iqr_base ORDER BY signal_rank) FILTER (WHERE iqr_base IS NOT NULL))[1] AS iqr_base,
    {', '.join(f'{_top(c)} AS {c}' for c in ['min_base', 'min_new', 'max_base', 'max_new', 'std_base', 'std_new', 'completeness_before',
                                             'completeness_after', 'baseline_label', 'fsi_label'])},
    {_wide('std_change')} AS worst_std_change, max(baseline_psi) AS baseline_psi, {_wide('velocity')} AS worst_velocity, min(fsi) AS worst_fsi
  FROM themed GROUP BY table_name, theme_id) t
""",
)
step(
    "b3",
    """
SELECT s.table_name, s.column_name, s.metric_type, s.severity, s.magnitude, s.slot, s.slot_rank, s.supporting, s.n_supporting, s.root_cause,
  f.* EXCLUDE (table_name, column_name),
  CASE WHEN s.metric_type = 'schema' THEN 'schema_event' WHEN s.metric_type = 'cardinality' THEN 'cardinality_explosion'
    WHEN s.metric_type IN ('psi', 'mean_shift', 'missingness') AND f.missing_pattern IN ('growing_missing', 'newly_missing', 'sparse') THEN 'data_loss'
    WHEN abs(coalesce(f.median_shift, 0)) > 0.2::DOUBLE OR abs(coalesce(f.last_mean_delta, 0)) > 0.1::DOUBLE THEN 'center_shift'
    WHEN abs(coalesce(f.upper_shift, 0)) > 0.1::DOUBLE OR abs(coalesce(f.lower_shift, 0)) > 0.1::DOUBLE THEN 'boundary_expansion'
    WHEN coalesce(f.std_change, 0) > 0.25 THEN 'spread_change' ELSE 'distribution_shift' END AS drift_cause
FROM pop s LEFT JOIN facts f ON s.table_name = f.table_name AND s.column_name = f.column_name AND s.metric_type <> 'schema'
""",
)
step(
    "stories",
    """
SELECT *, 'drift_story_' || slot_rank AS story_slot, CASE severity WHEN 'critical' THEN 'critical' WHEN 'notable' THEN 'warning' ELSE 'stable' END AS rag
FROM b3 WHERE slot = 'population' AND slot_rank <= 3
""",
)
step(
    "b4",
    """
SELECT *, 2 + CASE WHEN metric_type IN ('psi', 'mean_shift', 'missingness', 'cardinality', 'schema') THEN 1 ELSE 0 END
  + CASE WHEN metric_type = 'psi' AND contains(supporting, 'mean_shift') THEN 1 ELSE 0 END
  + CASE WHEN drift_cause IN ('center_shift', 'boundary_expansion', 'spread_change') THEN 1 ELSE 0 END + least(n_supporting, 2) AS n_evidence,
  CASE metric_type WHEN 'psi' THEN 'PSI ' || column_name WHEN 'mean_shift' THEN 'Mean shift ' || column_name
    WHEN 'missingness' THEN 'Completeness ' || column_name WHEN 'cardinality' THEN 'Cardinality ' || column_name
    WHEN 'schema' THEN 'Schema change ' || column_name
    ELSE CASE drift_cause WHEN 'center_shift' THEN 'Where in the distribution' WHEN 'boundary_expansion' THEN 'Range'
      WHEN 'spread_change' THEN 'Spread' ELSE 'Root cause' END END AS first_label FROM b3
""",
)
step(
    "b7",
    """
SELECT i5.table_name, 'target_behavior' AS slot, CASE WHEN drift_type IN ('organic_jump', 'label_change') THEN 'critical'
    WHEN drift_type IN ('organic_gradual', 'data_loss') THEN 'warning' ELSE 'stable' END AS severity,
  greatest(1, CASE WHEN event_rate_first IS NOT NULL AND event_rate_last IS NOT NULL THEN 1 ELSE 0 END
    + CASE WHEN coalesce(max_single_jump_pp, 0) > 0 THEN 1 ELSE 0 END
    + (SELECT count(*) FROM c5 WHERE c5.table_name = i5.table_name AND c5.severity <> 'stable')
    + CASE WHEN data_loss_risk THEN 1 ELSE 0 END + CASE WHEN target_found THEN 1 ELSE 0 END) AS n_evidence
FROM i5
""",
)
step(
    "b8",
    """
SELECT table_name, 'pipeline_quality' AS slot, CASE pattern WHEN 'systematic' THEN 'critical' WHEN 'isolated' THEN 'warning' ELSE 'stable' END AS severity,
  greatest(1, CASE WHEN health_score_delta IS NOT NULL THEN 1 ELSE 0 END
    + (SELECT count(*) FROM b3 WHERE b3.table_name = i9.table_name AND b3.slot = 'pipeline' AND b3.slot_rank <= 4)
    + CASE WHEN regressing_count > 0 THEN 1 ELSE 0 END) AS n_evidence,
  (SELECT count(*) FROM b3 WHERE b3.table_name = i9.table_name AND b3.slot = 'pipeline' AND b3.slot_rank <= 4 AND drift_cause = 'data_loss') > 0 AS lost
FROM i9
""",
)
step(
    "b9",
    """
SELECT table_name, 'model_scoring_risk' AS slot, CASE WHEN data_loss_only THEN 'warning' WHEN decision = 'retrain' THEN 'critical'
    WHEN decision IN ('rebin', 'recalibrate') THEN 'warning' ELSE 'stable' END AS severity,
  greatest(1, (SELECT count(*) FROM i8 WHERE i8.table_name = i7.table_name AND risk_rank <= 4)
    + (SELECT count(*) FROM i6 WHERE i6.table_name = i7.table_name AND is_real_drift AND column_name NOT IN
        (SELECT column_name FROM pop WHERE pop.table_name = i7.table_name AND pop.slot = 'population'))
    + CASE WHEN accelerating_cols <> '' THEN 1 ELSE 0 END + CASE WHEN unstable_cols <> '' THEN 1 ELSE 0 END) AS n_evidence
FROM i7
""",
)
step(
    "b10",
    """
SELECT table_name, 'governance_fairness' AS slot, CASE WHEN n = 0 THEN 'stable' WHEN moved > 0 THEN 'critical' ELSE 'warning' END AS severity,
  greatest(1, 2 * n) AS n_evidence, n
FROM (SELECT c0.table_name, (SELECT count(*) FROM b3 WHERE b3.table_name = c0.table_name AND slot = 'governance') AS n,
    (SELECT count(*) FROM b3 WHERE b3.table_name = c0.table_name AND slot = 'governance'
      AND metric_type IN ('psi', 'mean_shift', 'quantile_shift', 'boundary', 'std', 'kurtosis', 'entropy')) AS moved FROM c0) t
""",
)
step(
    "all_cards",
    """
SELECT table_name, story_slot AS slot, rag AS severity, n_evidence, slot_rank AS story_no, NULL::INTEGER AS place
  FROM stories JOIN b4 USING (table_name, column_name, metric_type, slot_rank)
UNION ALL SELECT table_name, slot, severity, n_evidence, NULL, 0 FROM b7
UNION ALL SELECT table_name, slot, severity, n_evidence, NULL, 1 FROM b8
UNION ALL SELECT table_name, slot, severity, n_evidence, NULL, 2 FROM b9
UNION ALL SELECT table_name, slot, severity, n_evidence, NULL, 3 FROM b10
""",
)
step(
    "card_list",
    """
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY CASE WHEN pinned THEN 0 WHEN story_no IS NOT NULL THEN 1 ELSE 2 END,
    coalesce(story_no, place)) AS card_order
FROM (SELECT *, sum(CASE WHEN pinned THEN 1 ELSE 0 END) OVER (PARTITION BY table_name) AS n_pinned
  FROM (SELECT *, place IN (0, 1) AND severity = 'critical' AND story_no IS NULL AS pinned FROM all_cards) t) u
WHERE story_no IS NULL OR story_no > n_pinned
""",
)
# strength of the action each card asks for, from its cause
step(
    "card_actions",
    """
SELECT c.table_name, c.slot, i7.decision, c0.verdict,
  coalesce(c.slot = 'governance_fairness' AND b10.n > 0, false) AS is_private,
  coalesce(c.slot = 'pipeline_quality' AND (b8.lost OR (b8.n_evidence = 1 AND i9.health_score_delta IS NULL AND i9.regressing_count = 0)), false)
    OR coalesce(s.drift_cause = 'data_loss', false) OR (c.slot = 'governance_fairness' AND EXISTS (SELECT 1 FROM b3
      WHERE b3.table_name = c.table_name AND b3.slot = 'governance' AND b3.drift_cause = 'data_loss')) AS has_loss,
  CASE WHEN c.story_no IS NOT NULL THEN CASE s.drift_cause WHEN 'center_shift' THEN 4 WHEN 'spread_change' THEN 4 WHEN 'cardinality_explosion' THEN 3
         WHEN 'distribution_shift' THEN 2 WHEN 'data_loss' THEN 2 ELSE 1 END
       WHEN c.slot = 'target_behavior' THEN CASE WHEN i5.drift_type IN ('label_change', 'organic_gradual', 'organic_jump') THEN 4 ELSE 1 END
       WHEN c.slot = 'model_scoring_risk' THEN CASE WHEN i7.rung = 'no_drift' THEN 1 ELSE 4 END ELSE 1 END AS original_rank,
  CASE i7.decision WHEN 'retrain' THEN 4 WHEN 'rebin' THEN 3 WHEN 'recalibrate' THEN 2 ELSE 1 END AS decision_rank,
  CASE c0.verdict WHEN 'MONITOR' THEN 2 WHEN 'BACK_TEST_REQUIRED' THEN 3 ELSE 1 END AS ceiling_rank
FROM card_list c JOIN i7 ON c.table_name = i7.table_name JOIN c0 ON c.table_name = c0.table_name JOIN i5 ON c.table_name = i5.table_name
  JOIN i9 ON c.table_name = i9.table_name JOIN b8 ON c.table_name = b8.table_name JOIN b10 ON c.table_name = b10.table_name
  LEFT JOIN stories s ON c.table_name = s.table_name AND c.slot = s.story_slot
""",
)
step(
    "v1",
    """
SELECT table_name, slot, is_private, has_loss, original_rank, concat_ws(' | ', CASE WHEN f2 THEN 'DATA_LOSS_MODEL_ACTION_BLOCKED' END,
    CASE WHEN f3 THEN 'DRIFT_STORY_EXCEEDS_I7' END, CASE WHEN f4 THEN 'EXCEEDS_VERDICT_CEILING' END,
    CASE WHEN f5 THEN 'GOVERNANCE_SIGNOFF_MISSING' END, CASE WHEN f6 THEN 'BLOCK_VERDICT_MODEL_ACTION_BLOCKED' END) AS fired_rules,
  NOT (f2 OR f3 OR f4 OR f5 OR f6) AS validation_passed, CASE WHEN f6 THEN 1 WHEN f4 THEN ceiling_rank ELSE k3 END AS final_rank
FROM (SELECT *, k3 > ceiling_rank AS f4, slot = 'governance_fairness' AND NOT is_private AS f5, verdict = 'BLOCK' AND original_rank >= 2 AS f6
  FROM (SELECT *, CASE WHEN f3 THEN decision_rank ELSE k2 END AS k3
    FROM (SELECT *, CASE WHEN f2 THEN 1 ELSE original_rank END AS k2, slot LIKE 'drift_story%' AND original_rank > decision_rank AS f3
      FROM (SELECT *, has_loss AND original_rank >= 2 AS f2 FROM card_actions) a) b) c) d
""",
)
