"""Interpretation steps."""

from oracle import step

_T = "('target', 'bad', 'default', 'event', 'flag', 'label', 'y')"

step(
    "i1_steps",
    """
SELECT table_name, version, column_name, pos, type, method, amount,
       row_number() OVER (PARTITION BY table_name, version, column_name ORDER BY pos) - 1 AS step_seq
FROM (
  SELECT table_name, version, column_name, 0 AS pos, 'quality_fix' AS type, 'blank to null' AS method,
         blank_value_count AS amount FROM sc WHERE w_blank
  UNION ALL SELECT table_name, version, column_name, 1, 'imputation',
         CASE WHEN has_shape AND abs(round(skewness, 4)) > 0.5 THEN 'median' ELSE 'mean' END, missing_count FROM sc WHERE w_partial
  UNION ALL SELECT table_name, version, column_name, 2, 'quality_fix', 'unify encoding', mismatched_count FROM sc WHERE w_format
  UNION ALL SELECT table_name, version, column_name, 3, 'outlier_cap', 'winsorise', n_outliers FROM sc
    WHERE has_shape AND n_outliers > 0
  UNION ALL SELECT table_name, version, column_name, 4, 'transformation',
         CASE WHEN round(skewness, 4) < -1 OR min_val < 0 THEN 'reflect then log1p' WHEN min_val > 0 THEN 'log' ELSE 'log1p' END, NULL
    FROM sc WHERE has_shape AND abs(round(skewness, 4)) > 1) t
""",
)
step(
    "i1",
    """
SELECT *, row_number() OVER (PARTITION BY table_name, version
    ORDER BY CASE verdict WHEN 'exclude' THEN 0 WHEN 'drop' THEN 1 WHEN 'fix_then_use' THEN 2 ELSE 3 END, seen_group, col_seq) AS verdict_rank,
  CASE WHEN cause = 'clean' THEN 'none' WHEN cause = 'PRIVACY' THEN 'high'
       WHEN cause IN ('high_missing', 'severe_mismatch') OR (cause = 'needs_steps' AND k > 1) THEN 'medium' ELSE 'low' END AS effort,
  CASE WHEN cause = 'needs_steps' THEN k ELSE 0 END AS n_steps
FROM (SELECT *, CASE WHEN cause IN ('LEAKAGE', 'PRIVACY') THEN 'exclude' WHEN cause = 'needs_steps' THEN 'fix_then_use'
          WHEN cause = 'clean' THEN 'use' ELSE 'drop' END AS verdict
  FROM (SELECT s.table_name, s.version, s.column_name, s.col_seq, coalesce(k, 0) AS k,
          CASE WHEN blocked THEN 0 WHEN warned THEN 1 WHEN governed THEN 2 WHEN has_shape THEN 3 ELSE 4 END AS seen_group,
          CASE WHEN prob_like THEN 'LEAKAGE' WHEN g_identifier THEN 'IDENTIFIER' WHEN g_privacy THEN 'PRIVACY'
               WHEN b_zero THEN 'zero_variance' WHEN b_missing THEN 'high_missing' WHEN b_mismatch THEN 'severe_mismatch'
               WHEN k > 0 THEN 'needs_steps' ELSE 'clean' END AS cause
        FROM sc s LEFT JOIN (SELECT table_name, version, column_name, count(*) AS k FROM i1_steps GROUP BY 1, 2, 3) q
          ON s.table_name = q.table_name AND s.version = q.version AND s.column_name = q.column_name) t) u
""",
)
step(
    "i2",
    """
SELECT * EXCLUDE (minority), CASE WHEN training_ready THEN minority END AS minority_count,
  CASE WHEN training_ready THEN row_count - minority END AS majority_count,
  CASE WHEN training_ready THEN CASE WHEN balance_label = 'balanced' THEN 'stratified_split'
    WHEN balance_label = 'moderate' THEN 'class_weight_kfold' WHEN minority < 300 THEN 'class_weight_only'
    WHEN minority < 2000 THEN 'class_weight_smote_capped' ELSE 'threshold_calibration' END END AS strategy,
  training_ready AND CASE WHEN balance_label = 'balanced' THEN false WHEN balance_label = 'moderate' THEN minority > 1000
    ELSE minority BETWEEN 300 AND 1999 END AS smote_recommended,
  CASE WHEN training_ready THEN CASE WHEN balance_label IN ('balanced', 'moderate') THEN 'ROC-AUC' ELSE 'Precision-Recall AUC' END END AS primary_metric,
  CASE WHEN training_ready THEN CASE balance_label WHEN 'balanced' THEN 'F1' WHEN 'moderate' THEN 'Precision-Recall AUC' ELSE 'ROC-AUC' END END AS secondary_metric
FROM (SELECT *, stop_reason IS NULL AS training_ready
  FROM (SELECT v.table_name, v.version, v.row_count, s.score AS readiness_score, s.readiness_label, t.column_name AS target, t.event_rate,
          t.imbalance_ratio, t.balance_label, t.completeness,
          CAST(round_even(t.event_rate / 100 * v.row_count, 0) AS BIGINT) AS minority,
          CASE WHEN s.readiness_label = 'not_ready' THEN 'dataset_not_ready' WHEN t.column_name IS NULL THEN 'no_target'
               WHEN t.error IS NOT NULL THEN 'target_error' WHEN t.blocked THEN 'target_blocked'
               WHEN t.completeness < 95 THEN 'target_incomplete' END AS stop_reason
        FROM vers v JOIN s0l s ON v.table_name = s.table_name AND v.version = s.version
          LEFT JOIN s6 t ON v.table_name = t.table_name AND v.version = t.version) a) b
""",
)
_SHARE = "(drifted_count / greatest(total_features, 1)::DOUBLE)"


def _ordered(cond: str) -> str:
    return f"coalesce(string_agg(CASE WHEN {cond} THEN column_name END, ',' ORDER BY first_version, first_seq), '')"


step(
    "i4",
    f"""
SELECT table_name, shift_scope, coordinated, drifted_count, total_features, drifted_features, row_delta_pct,
  CASE WHEN shift_scope = 'unknown' OR shift_share IS NULL THEN 'unknown' WHEN shift_share > 0.3::DOUBLE THEN 'far'
       WHEN moved_share > 0.3::DOUBLE THEN 'moderate' ELSE 'close' END AS v1_distance,
  CASE shift_scope WHEN 'unknown' THEN 'unknown' WHEN 'stable' THEN 'none'
       ELSE CASE WHEN abs(row_delta_pct) > 20 THEN 'sampling_change' WHEN coordinated THEN 'organic_population_change'
            ELSE 'mixed_or_pipeline' END END AS likely_cause
FROM (SELECT *, CASE WHEN total_features = 0 THEN 'unknown' WHEN {_SHARE} > 0.3::DOUBLE THEN 'broad' WHEN {_SHARE} > 0.1::DOUBLE THEN 'narrow'
          ELSE 'stable' END AS shift_scope,
        CASE WHEN total_features > 0 THEN raw_delta END AS row_delta_pct,
        drifted_count >= 3 AND up + down >= 3 AND greatest(up, down) / greatest(up + down, 1)::DOUBLE > 0.7::DOUBLE AS coordinated
  FROM (SELECT d.table_name, coalesce(f.total_features, 0) AS total_features, coalesce(f.drifted_count, 0) AS drifted_count,
          coalesce(f.up, 0) AS up, coalesce(f.down, 0) AS down, coalesce(f.names, '') AS drifted_features,
          r.raw_delta, b.shift_share, b.moved_share
    FROM c9d d
    LEFT JOIN (SELECT table_name, count(*) AS total_features, count(CASE WHEN overall_severity <> 'stable' THEN 1 END) AS drifted_count,
        count(CASE WHEN overall_severity <> 'stable' AND last_mean_delta > 0 THEN 1 END) AS up,
        count(CASE WHEN overall_severity <> 'stable' AND last_mean_delta < 0 THEN 1 END) AS down,
        {_ordered("overall_severity <> 'stable'")} AS names
      FROM c4 JOIN uni USING (table_name, column_name) GROUP BY table_name) f ON d.table_name = f.table_name
    LEFT JOIN (SELECT v1.table_name, round((v2.row_count - v1.row_count) / v1.row_count::DOUBLE * 100, 1) AS raw_delta
      FROM vers v1 JOIN vers v2 ON v1.table_name = v2.table_name AND v2.ver_idx = v1.ver_idx + 1
      WHERE v2.ver_idx = v2.n_versions - 1) r ON d.table_name = r.table_name
    LEFT JOIN (SELECT table_name, avg(CASE WHEN worst_label = 'shift' THEN 1.0::DOUBLE ELSE 0 END) AS shift_share,
        avg(CASE WHEN worst_label IN ('shift', 'monitor') THEN 1.0::DOUBLE ELSE 0 END) AS moved_share FROM d13 GROUP BY table_name) b
      ON d.table_name = b.table_name) t) u
""",
)
step(
    "i4c",
    f"""
SELECT *, CASE WHEN {_SHARE} > 0.3::DOUBLE AND sampling_signal THEN 'sampling_shift_confirmed'
  WHEN coordinated AND {_SHARE} > 0.3::DOUBLE THEN 'true_population_shift' WHEN {_SHARE} < 0.1::DOUBLE THEN 'noise_or_local'
  ELSE 'mixed_shift' END AS refined_cause
FROM (SELECT *, coalesce(abs(row_delta_pct) > 20, false) AS sampling_signal FROM i4) t
""",
)
step(
    "i5",
    """
SELECT table_name, target_found, target_column, label_change_risk, data_loss_risk, event_rate_first, event_rate_last,
  total_drift_pp, max_single_jump_pp, missing_pattern,
  CASE WHEN NOT target_found THEN NULL WHEN n_pairs = 0 THEN 'stable' WHEN data_loss_risk THEN 'data_loss'
       WHEN label_change_risk THEN 'label_change' WHEN n_pairs >= 2 AND max_single_jump_pp < 3 THEN 'organic_gradual'
       ELSE 'organic_jump' END AS drift_type
FROM (SELECT d.table_name, t.column_name IS NOT NULL AS target_found, t.column_name AS target_column, r.event_rate_first,
    r.event_rate_last, c3.missing_pattern, coalesce(p.n_pairs, 0) AS n_pairs,
    CASE WHEN t.column_name IS NOT NULL THEN coalesce(p.total, 0) END AS total_drift_pp, p.jump AS max_single_jump_pp,
    coalesce(p.n_pairs > 0 AND c3.missing_pattern IN ('growing_missing', 'newly_missing', 'sparse'), false) AS data_loss_risk,
    coalesce(p.n_pairs > 0 AND (coalesce(c6.mismatch_trend = 'regressing', false) OR p.jump > 5), false) AS label_change_risk
  FROM c9d d LEFT JOIN (SELECT DISTINCT table_name, column_name FROM c5_rates) t ON d.table_name = t.table_name
  LEFT JOIN (SELECT table_name, max(CASE WHEN ver_idx = 0 THEN event_rate END) AS event_rate_first,
      last(event_rate ORDER BY ver_idx) AS event_rate_last FROM c5_rates GROUP BY table_name) r ON r.table_name = d.table_name
  LEFT JOIN (SELECT table_name, count(*) AS n_pairs, round(sum(delta_pp), 2) AS total, max(abs_delta_pp) AS jump FROM c5 GROUP BY table_name) p
    ON p.table_name = d.table_name
  LEFT JOIN c3 ON c3.table_name = t.table_name AND c3.column_name = t.column_name
  LEFT JOIN c6 ON c6.table_name = t.table_name AND c6.column_name = t.column_name) q
""",
)
step(
    "i5c",
    """
SELECT *, CASE WHEN data_loss_risk THEN 'data_loss_confirmed' WHEN coalesce(max_single_jump_pp, 0) > 5 THEN 'label_definition_change'
  WHEN abs(coalesce(total_drift_pp, 0)) > 5 THEN 'real_population_shift' ELSE drift_type END AS refined_drift_type FROM i5
""",
)
step(
    "last_suite",
    """
SELECT table_name, column_name, round(median_shift, 4) AS median_shift, round(upper_shift, 4) AS upper_shift,
  round(lower_shift, 4) AS lower_shift, round(std_change, 4) AS std_change, boundary_severity,
  round(max_boundary_shift, 4) AS max_boundary_shift FROM suite WHERE last_pair
""",
)
step(
    "i6",
    """
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY NOT is_real_drift, column_name) AS impact_rank,
  CASE WHEN NOT is_real_drift THEN 'data_loss' WHEN median_abs > 0.2::DOUBLE OR abs(mean_delta) > 0.1::DOUBLE THEN 'center_shift'
       WHEN upper_abs > 0.1::DOUBLE OR lower_abs > 0.1::DOUBLE THEN 'boundary_expansion' WHEN std_norm > 0.25 THEN 'spread_change'
       ELSE 'distribution_shift' END AS drift_cause
FROM (SELECT w.table_name, w.column_name, w.first_version, w.first_seq, w.worst_label AS psi_label, w.last_psi, c3.missing_pattern,
    NOT coalesce(c3.missing_pattern IN ('growing_missing', 'newly_missing', 'sparse'), false) AS is_real_drift,
    coalesce(c4.last_mean_delta, 0) AS mean_delta, coalesce(abs(l.median_shift), 0) AS median_abs,
    coalesce(abs(l.upper_shift), 0) AS upper_abs, coalesce(abs(l.lower_shift), 0) AS lower_abs, coalesce(l.std_change, 0) AS std_norm
  FROM c8 w LEFT JOIN c3 ON c3.table_name = w.table_name AND c3.column_name = w.column_name
    LEFT JOIN c4 ON c4.table_name = w.table_name AND c4.column_name = w.column_name
    LEFT JOIN last_suite l ON l.table_name = w.table_name AND l.column_name = w.column_name
  WHERE w.worst_label IN ('shift', 'monitor')) t
""",
)
step(
    "i6c",
    """
SELECT *, CASE WHEN NOT is_real_drift THEN 'data_loss' WHEN m = '' THEN 'weak_shift' ELSE m END AS drift_mechanism
FROM (SELECT *, concat_ws('+', CASE WHEN median_abs > 0.2::DOUBLE OR abs(mean_delta) > 0.1::DOUBLE THEN 'center_shift' END,
    CASE WHEN upper_abs > 0.1::DOUBLE THEN 'boundary_expansion' END, CASE WHEN std_norm > 0.25 THEN 'spread_change' END) AS m FROM i6) t
""",
)
step(
    "i7",
    """
SELECT *, CASE WHEN rung IN ('quality_block', 'no_drift', 'features_lost_data', 'labels_lost_data') THEN 'hold'
    WHEN rung IN ('label_redefined', 'target_moved') THEN 'retrain' WHEN rung = 'manageable' THEN 'recalibrate' ELSE 'rebin' END AS decision,
  CASE WHEN rung = 'no_drift' THEN 'none' WHEN rung IN ('quality_block', 'features_lost_data', 'labels_lost_data') THEN 'pipeline_fix_first'
    WHEN rung = 'label_redefined' THEN 'immediate' ELSE 'next_cycle' END AS urgency
FROM (SELECT table_name, verdict, target_found, drift_type, total_drift_pp, impact_count, real_drift_count, drifted_columns,
    accelerating_cols, unstable_cols, data_loss_only,
    CASE WHEN verdict = 'BLOCK' THEN 'quality_block' WHEN verdict = 'CLEAR' THEN 'no_drift' WHEN data_loss_only THEN 'features_lost_data'
      WHEN drift_type = 'data_loss' THEN 'labels_lost_data' WHEN drift_type = 'label_change' THEN 'label_redefined'
      WHEN drift_type = 'organic_jump' OR (target_found AND abs(total_drift_pp) > 5) THEN 'target_moved'
      WHEN real_drift_count > 0 AND centers = real_drift_count THEN 'centers_moved' WHEN boundaries > 0 THEN 'limits_moved'
      WHEN unstable_cols <> '' THEN 'chronically_unstable' ELSE 'manageable' END AS rung
  FROM (SELECT c0.table_name, c0.verdict, i5.target_found, i5.drift_type, i5.total_drift_pp, coalesce(f.n, 0) AS impact_count,
      coalesce(f.r, 0) AS real_drift_count, coalesce(f.centers, 0) AS centers, coalesce(f.boundaries, 0) AS boundaries,
      coalesce(f.names, '') AS drifted_columns, coalesce(s.fast, '') AS accelerating_cols, coalesce(s.shaky, '') AS unstable_cols,
      coalesce(f.n > 0 AND f.r = 0, false) AS data_loss_only
    FROM c0 JOIN i5 ON c0.table_name = i5.table_name
    LEFT JOIN (SELECT table_name, count(*) AS n, count(CASE WHEN is_real_drift THEN 1 END) AS r,
        count(CASE WHEN is_real_drift AND drift_cause = 'center_shift' THEN 1 END) AS centers,
        count(CASE WHEN is_real_drift AND drift_cause = 'boundary_expansion' THEN 1 END) AS boundaries,
        coalesce(string_agg(CASE WHEN is_real_drift THEN column_name END, ',' ORDER BY column_name), '') AS names
      FROM i6 GROUP BY table_name) f ON c0.table_name = f.table_name
    LEFT JOIN (SELECT table_name, """
    + _ordered("velocity > 0.05::DOUBLE")
    + " AS fast, "
    + _ordered("fsi < 0.4::DOUBLE")
    + """ AS shaky FROM d11 JOIN uni USING (table_name, column_name) GROUP BY table_name) s ON c0.table_name = s.table_name) t) u
""",
)
step(
    "i7c",
    """
SELECT table_name, decision, drift_type, total_drift_pp, velocity_flag, unstable_count,
  CASE WHEN d = 'recalibrate' AND velocity_flag THEN 'rebin' WHEN d = 'retrain' AND unstable_count > 0 THEN 'rebin' ELSE d END AS refined_decision
FROM (SELECT i7.*, accelerating_cols <> '' AS velocity_flag,
    CASE WHEN unstable_cols = '' THEN 0 ELSE len(string_split(unstable_cols, ',')) END AS unstable_count,
    CASE WHEN NOT EXISTS (SELECT 1 FROM i6c x WHERE x.table_name = i7.table_name AND x.drift_mechanism <> 'data_loss') THEN 'hold'
         WHEN c.refined_drift_type = 'label_definition_change' THEN 'retrain' ELSE i7.decision END AS d
  FROM i7 JOIN i5c c ON i7.table_name = c.table_name) t
""",
)
step(
    "i8",
    """
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY severity <> 'critical', column_name, risk) AS risk_rank
FROM (SELECT table_name, column_name, CASE change WHEN 'dropped' THEN 'dropped_feature' ELSE 'type_mismatch' END AS risk,
        'critical' AS severity, NULL::DOUBLE AS measure FROM c2 WHERE last_pair AND change <> 'added'
      UNION ALL SELECT table_name, column_name, 'cardinality_explosion', severity, ratio FROM c10 e
        WHERE severity IN ('critical', 'notable') AND pair_idx = (SELECT max(pair_idx) FROM c10 x
          WHERE x.table_name = e.table_name AND x.column_name = e.column_name)
      UNION ALL SELECT table_name, column_name, 'range_extrapolation', 'notable', max_boundary_shift FROM last_suite
        WHERE boundary_severity = 'critical' AND (abs(upper_shift) >= 0.25 OR abs(lower_shift) >= 0.25)) t
""",
)
step(
    "i9",
    f"""
SELECT *, CASE WHEN pattern IN ('systematic', 'isolated') THEN 'degrading' ELSE pattern END AS feed_health, pattern = 'systematic' AS escalate
FROM (SELECT *, CASE WHEN is_systematic AND health_score_delta < -5 THEN 'systematic' WHEN degrading_count > 0 AND NOT is_systematic THEN 'isolated'
          WHEN degrading_count = 0 AND recovering_count > 0 THEN 'recovering' WHEN health_score_delta > 3 THEN 'improving' ELSE 'stable' END AS pattern
  FROM (SELECT f.*, d.n_versions, d.score_delta AS health_score_delta,
      CASE WHEN degrading_count > 0 AND d.n_versions >= 2 THEN first_gap END AS first_seen_version,
      degrading_count / total_cols::DOUBLE > 0.2::DOUBLE OR (degrading_count >= 3 AND d.n_versions >= 3) OR regressing_count >= 3 AS is_systematic,
      (SELECT CASE WHEN n >= 2 THEN prefix END FROM (SELECT string_split(lower(column_name), '_')[1] AS prefix, count(*) AS n,
          min(first_version * 100000 + first_seq) AS place FROM c3 p WHERE p.table_name = f.table_name AND contains(column_name, '_')
          AND missing_pattern IN ('growing_missing', 'newly_missing') GROUP BY 1 ORDER BY n DESC, place LIMIT 1)) AS shared_prefix
    FROM (SELECT table_name, count(*) AS total_cols, count(CASE WHEN bad THEN 1 END) AS degrading_count,
        count(CASE WHEN missing_pattern = 'recovering' THEN 1 END) AS recovering_count,
        count(CASE WHEN missing_pattern = 'sparse' THEN 1 END) AS sparse_count,
        count(CASE WHEN worse THEN 1 END) AS regressing_count, {_ordered('bad')} AS affected_columns,
        {_ordered("missing_pattern = 'sparse'")} AS sparse_columns, {_ordered("missing_pattern = 'recovering'")} AS recovering_columns,
        {_ordered('worse')} AS quality_regressing,
        arg_min(first_gap_version, first_version * 100000 + first_seq) FILTER (WHERE bad) AS first_gap
      FROM (SELECT c3.*, missing_pattern IN ('growing_missing', 'newly_missing') AS bad,
          coalesce(c6.mismatch_trend = 'regressing' OR c6.blank_trend = 'regressing', false) AS worse
        FROM c3 LEFT JOIN c6 ON c3.table_name = c6.table_name AND c3.column_name = c6.column_name) q GROUP BY table_name) f
    JOIN c9d d ON f.table_name = d.table_name) t) u
""",
)
step(
    "i9c",
    """
SELECT *, CASE WHEN degrading_count > 0.2::DOUBLE * total_cols THEN 'systemic_failure' WHEN degrading_count > 0 THEN 'localized_failure'
  ELSE 'healthy' END AS failure_mode FROM i9
""",
)
step(
    "s0_history",
    "SELECT table_name, string_agg(CAST(score AS VARCHAR), ',' ORDER BY version) AS dataset_scores FROM s0l GROUP BY table_name",
)
