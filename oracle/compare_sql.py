"""Grid, pair, drift and comparison steps."""

from oracle import step

SIDE = [
    "data_type", "cas_data_type", "statistical_scale", "completeness_percent", "cardinality_count",
    "uniqueness_percent", "mean", "std", "min_val", "max_val", "skewness", "kurtosis", "q25", "q50", "q75",
    "has_outliers", "n_outliers", "blank_value_count", "mismatched_count", "status", "score",
]

step(
    "vers",
    """
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY version) - 1 AS ver_idx,
       count(*) OVER (PARTITION BY table_name) AS n_versions
FROM (SELECT table_name, version, any_value(abt_name) AS abt_name, any_value(row_count) AS row_count,
             count(*) AS col_count FROM prof GROUP BY table_name, version) t
""",
)
step(
    "uni",
    """
SELECT table_name, column_name, min(version) AS first_version, arg_min(col_seq, version) AS first_seq
FROM prof GROUP BY table_name, column_name
""",
)
step(
    "gridq",
    """
SELECT u.table_name, u.column_name, first_version, first_seq, v.version, v.ver_idx, v.n_versions,
       v.abt_name AS ver_name, s.column_name IS NOT NULL AS present, s.* EXCLUDE (table_name, column_name, version, abt_name),
       z.data_type AS z_type, z.statistical_scale AS z_scale
FROM uni u JOIN vers v ON u.table_name = v.table_name
     LEFT JOIN sc s ON s.table_name = u.table_name AND s.column_name = u.column_name AND s.version = v.version
     JOIN vers v0 ON v0.table_name = u.table_name AND v0.ver_idx = 0
     LEFT JOIN sc z ON z.table_name = u.table_name AND z.column_name = u.column_name AND z.version = v0.version
""",
)


def _pairs(on: str) -> str:
    a = ", ".join(f"a.{c} AS a_{c}" for c in SIDE)
    b = ", ".join(f"b.{c} AS b_{c}" for c in SIDE)
    return f"""
SELECT u.table_name, u.column_name, first_version, first_seq, v1.n_versions, v1.ver_idx AS pair_idx,
       v1.ver_idx = v1.n_versions - 2 AS last_pair, v2.ver_idx AS to_idx, v1.abt_name AS from_ver, v2.abt_name AS to_ver,
       v1.row_count AS from_rows, v2.row_count AS to_rows, a.column_name IS NOT NULL AS in_a,
       b.column_name IS NOT NULL AS in_b, z.column_name IS NOT NULL AS in_z, z.data_type AS z_type,
       z.statistical_scale AS z_scale, {a}, {b}
FROM uni u JOIN vers v1 ON u.table_name = v1.table_name
     JOIN vers v2 ON v2.table_name = u.table_name AND {on}
     JOIN vers v0 ON v0.table_name = u.table_name AND v0.ver_idx = 0
     LEFT JOIN sc a ON a.table_name = u.table_name AND a.column_name = u.column_name AND a.version = v1.version
     LEFT JOIN sc b ON b.table_name = u.table_name AND b.column_name = u.column_name AND b.version = v2.version
     LEFT JOIN sc z ON z.table_name = u.table_name AND z.column_name = u.column_name AND z.version = v0.version
"""


step("pp", _pairs("v2.ver_idx = v1.ver_idx + 1"))
step("pb", _pairs("v1.ver_idx = 0 AND v2.ver_idx > 0"))

_TARGETS = "('target', 'bad', 'default', 'event', 'flag', 'label', 'y')"
_PTS = ["min_val", "q25", "q50", "q75", "max_val"]
_NUM = "(a_data_type = 'num' AND b_data_type = 'num')"


def _cdf(x: str, side: str) -> str:
    p = [f"{side}_{c}" for c in _PTS]
    segs = " ".join(
        f"WHEN {x} >= {p[i]} AND {x} <= {p[i + 1]} THEN CASE WHEN abs({p[i + 1]} - {p[i]}) < 1e-9 THEN {i / 4}::DOUBLE "
        f"ELSE {i / 4}::DOUBLE + ({x} - {p[i]}) / ({p[i + 1]} - {p[i]}) * 0.25::DOUBLE END"
        for i in range(4)
    )
    return f"(CASE WHEN {x} <= {p[0]} THEN 0::DOUBLE WHEN {x} >= {p[4]} THEN 1::DOUBLE {segs} ELSE 1::DOUBLE END)"


def _has(side: str) -> str:
    return "(" + " AND ".join(f"{side}_{c} IS NOT NULL" for c in _PTS) + ")"


_EDGES = ["e0", "a_q25", "a_q50", "a_q75", "e4"]


def _psi_steps(name: str, source: str) -> None:
    step(
        f"{name}_edges",
        f"""
SELECT *, least(coalesce(a_min_val, a_q25), coalesce(b_min_val, b_q25)) AS e0,
       greatest(coalesce(a_max_val, a_q75), coalesce(b_max_val, b_q75)) AS e4,
       CASE WHEN NOT (in_a AND in_b) THEN 'absent' WHEN NOT {_NUM} THEN 'ok'
            WHEN a_statistical_scale IN ('id', 'binary', 'unary') THEN 'not_applicable'
            WHEN a_q25 IS NULL OR a_q50 IS NULL OR a_q75 IS NULL THEN 'insufficient_data' ELSE 'ok' END AS psi_state
FROM {source}
""",
    )
    mass = ", ".join(
        f"CASE WHEN {_has(s)} THEN greatest(0, {_cdf(hi, s)} - {_cdf(lo, s)}) ELSE 0.25 END "
        f"* coalesce({s}_completeness_percent, 100) / 100 AS {s}m{i}"
        for s in "ab"
        for i, (lo, hi) in enumerate(zip(_EDGES, _EDGES[1:]))
    )
    step(f"{name}_mass", f"SELECT *, {mass} FROM {name}_edges")
    share = ", ".join(
        f"CASE WHEN {s}m0 + {s}m1 + {s}m2 + {s}m3 <= 0 THEN 0.25::DOUBLE ELSE greatest({s}m{i} / ({s}m0 + {s}m1 + {s}m2 + {s}m3), 1e-6) END AS {s}s{i}"
        for s in "ab"
        for i in range(4)
    )
    step(f"{name}_share", f"SELECT *, {share} FROM {name}_mass")
    total = " + ".join(f"(bs{i} - as{i}) * ln(bs{i} / as{i})" for i in range(4))
    step(
        f"{name}_raw",
        f"""
SELECT *, CASE WHEN psi_state <> 'ok' THEN NULL WHEN {_NUM} THEN {total}
  WHEN a_cardinality_count <> b_cardinality_count THEN least(0.15::DOUBLE * abs(a_cardinality_count - b_cardinality_count), 1)
  WHEN (a_completeness_percent > 0) = (b_completeness_percent > 0) THEN 0
  ELSE (0.5 - 1.0::DOUBLE / greatest(a_cardinality_count, 1)) * ln(0.5 * greatest(a_cardinality_count, 1)) END AS psi_raw
FROM {name}_share
""",
    )
    step(
        name,
        f"""
SELECT *, round(psi_raw, 4) AS psi, psi_raw IS NOT NULL AS psi_applicable,
  CASE WHEN psi_raw IS NULL THEN psi_state WHEN psi_raw < 0.1 THEN 'stable' WHEN psi_raw < 0.25 THEN 'monitor' ELSE 'shift' END
    AS psi_label
FROM {name}_raw
""",
    )


_psi_steps("ppsi", "pp")
_psi_steps("pbase", "pb")


def _sev(value: str, notable: float, critical: float) -> str:
    return (
        f"CASE WHEN {value} >= {critical}::DOUBLE THEN 'critical' WHEN {value} >= {notable}::DOUBLE THEN 'notable' "
        f"WHEN {value} IS NOT NULL THEN 'stable' END"
    )


def _entropy(s: str) -> str:
    top = f"greatest(0, least(1, 1 - {s}_uniqueness_percent / 100))"
    rest = f"((1 - {top}) / greatest({s}_cardinality_count - 1, 1))"
    return (
        f"CASE WHEN {s}_cardinality_count <= 1 THEN 0 ELSE greatest(0, "
        f"CASE WHEN {top} > 1e-9 THEN -{top} * log2({top}) ELSE 0 END - "
        f"CASE WHEN {rest} > 1e-9 THEN ({s}_cardinality_count - 1) * {rest} * log2({rest}) ELSE 0 END) END"
    )


_KS = [f"abs({_cdf(f'a_{c}', 'b')} - {i / 4}::DOUBLE)" for i, c in enumerate(_PTS)]
step(
    "raw_metrics",
    f"""
SELECT *,
  CASE WHEN {_NUM} AND abs(a_mean) >= 1e-6 AND abs(b_mean) > 1e-6 AND b_std IS NOT NULL THEN a_std / abs(a_mean) END AS cv_base,
  CASE WHEN {_NUM} AND abs(a_mean) >= 1e-6 AND abs(b_mean) > 1e-6 AND a_std IS NOT NULL THEN b_std / abs(b_mean) END AS cv_new,
  CASE WHEN {_NUM} AND a_std >= 1e-9 THEN abs(b_std - a_std) / a_std END AS std_change,
  CASE WHEN {_NUM} AND a_std >= 1e-9 AND b_std IS NOT NULL THEN CASE WHEN b_std > a_std THEN 'widened' ELSE 'narrowed' END END AS std_direction,
  CASE WHEN {_NUM} AND b_q50 IS NOT NULL THEN greatest(a_q75 - a_q25, 1e-9) END AS iqr_base,
  CASE WHEN {_NUM} THEN (b_q25 - a_q25) / greatest(a_q75 - a_q25, 1e-9) END AS q1_shift,
  CASE WHEN {_NUM} THEN (b_q50 - a_q50) / greatest(a_q75 - a_q25, 1e-9) END AS median_shift,
  CASE WHEN {_NUM} THEN (b_q75 - a_q75) / greatest(a_q75 - a_q25, 1e-9) END AS q3_shift,
  CASE WHEN {_NUM} THEN (b_min_val - a_min_val) / greatest(abs(a_max_val - a_min_val), 1e-9) END AS lower_shift,
  CASE WHEN {_NUM} THEN (b_max_val - a_max_val) / greatest(abs(a_max_val - a_min_val), 1e-9) END AS upper_shift,
  CASE WHEN {_NUM} THEN b_kurtosis - a_kurtosis END AS kurtosis_delta,
  CASE WHEN NOT (a_data_type = 'num' AND a_statistical_scale <> 'binary') AND a_cardinality_count > 0 AND b_cardinality_count > 0
       AND {_entropy('a')} >= 1e-9 THEN {_entropy('a')} END AS entropy_base,
  CASE WHEN NOT (a_data_type = 'num' AND a_statistical_scale <> 'binary') AND a_cardinality_count > 0 AND b_cardinality_count > 0
       AND {_entropy('a')} >= 1e-9 THEN {_entropy('b')} END AS entropy_new,
  CASE WHEN {_NUM} AND {_has('a')} AND {_has('b')} THEN [{', '.join(_KS)}] END AS gaps
FROM ppsi
""",
)
step(
    "pm",
    f"""
SELECT *, {_sev('cv_change', 0.2, 0.5)} AS cv_severity, {_sev('std_change', 0.25, 0.5)} AS std_severity,
  {_sev('max_quantile_shift', 0.2, 0.5)} AS quantile_severity, {_sev('max_boundary_shift', 0.1, 0.25)} AS boundary_severity,
  {_sev('abs(kurtosis_delta)', 1, 3)} AS kurtosis_severity, {_sev('entropy_change', 0.15, 0.35)} AS entropy_severity,
  {_sev('ks', 0.1, 0.2)} AS ks_severity
FROM (SELECT *, abs(cv_new - cv_base) / greatest(cv_base, 1e-9) AS cv_change,
        greatest(abs(q1_shift), abs(median_shift), abs(q3_shift)) AS max_quantile_shift,
        CASE greatest(abs(q1_shift), abs(median_shift), abs(q3_shift)) WHEN abs(q1_shift) THEN 'Q1'
          WHEN abs(median_shift) THEN 'Median' WHEN abs(q3_shift) THEN 'Q3' END AS worst_quantile,
        greatest(abs(lower_shift), abs(upper_shift)) AS max_boundary_shift,
        abs(entropy_new - entropy_base) / entropy_base AS entropy_change,
        list_max(gaps) AS ks,
        ['min', 'Q1', 'Median', 'Q3', 'max'][list_position(gaps, list_max(gaps))] AS ks_point
      FROM raw_metrics) t
""",
)
step("suite", f"SELECT * FROM pm WHERE in_z AND z_scale NOT IN ('id', 'unary') AND lower(column_name) NOT IN {_TARGETS}")
step(
    "d11",
    """
SELECT *, CASE WHEN fsi IS NULL THEN 'insufficient_data' WHEN fsi >= 0.7 THEN 'stable' WHEN fsi >= 0.4 THEN 'monitor'
            ELSE 'unstable' END AS fsi_label,
       CASE WHEN velocity IS NULL THEN 'insufficient_data' WHEN abs(velocity) >= 0.15 THEN 'critical'
            WHEN abs(velocity) >= 0.05 THEN 'notable' ELSE 'stable' END AS velocity_label
FROM (SELECT table_name, column_name, n_pairs, round(sy / n_pairs::DOUBLE) / 10000 AS mean_psi,
        CASE WHEN n_pairs > 0 THEN greatest(0, round(10000 - sy / n_pairs::DOUBLE / 0.25) / 10000) END AS fsi,
        CASE WHEN n_pairs >= 2 THEN CASE WHEN n_pairs * sxx = sx * sx THEN 0
          ELSE round((n_pairs * sxy - sx * sy)::DOUBLE / (n_pairs * sxx - sx * sx)::DOUBLE) / 10000 END END AS velocity
      FROM (SELECT table_name, column_name, count(psi) AS n_pairs, sum(CASE WHEN psi IS NOT NULL THEN pair_idx END) AS sx,
              sum(CAST(round(psi * 10000) AS BIGINT)) AS sy, sum(pair_idx * CAST(round(psi * 10000) AS BIGINT)) AS sxy,
              sum(CASE WHEN psi IS NOT NULL THEN pair_idx * pair_idx END) AS sxx
            FROM suite GROUP BY table_name, column_name) r) t
""",
)
step(
    "pbs",
    "SELECT * FROM pbase WHERE in_a AND a_statistical_scale NOT IN ('id', 'unary')",
)
_WORST = """CASE WHEN bool_or(psi_applicable AND psi_label = 'shift') THEN 'shift'
            WHEN bool_or(psi_applicable AND psi_label = 'monitor') THEN 'monitor'
            WHEN bool_or(psi_applicable) THEN 'stable' ELSE 'not_applicable' END"""
step(
    "d13",
    f"""
SELECT table_name, column_name, {_WORST} AS worst_label,
       arg_max(psi, to_idx) FILTER (WHERE psi_applicable) AS last_psi
FROM pbs GROUP BY table_name, column_name
""",
)

# ── comparison ──────────────────────────────────────────────────────────────────────────────────
_ORD = "(CASE {0} WHEN 'absent' THEN -1 WHEN 'caution' THEN 1 WHEN 'drop' THEN 2 ELSE 0 END)"
_MOVE = f"({_ORD.format('b_status')} - {_ORD.format('a_status')})"


def _names(cond: str) -> str:
    return f"coalesce(string_agg(CASE WHEN {cond} THEN column_name END, ',' ORDER BY column_name), '')"


step(
    "c1",
    f"""
SELECT table_name, pair_idx, from_ver, to_ver, from_rows, to_rows, to_rows - from_rows AS row_delta,
  {_names('NOT in_a AND in_b')} AS added, {_names('in_a AND NOT in_b')} AS dropped,
  {_names(f'in_a AND in_b AND {_MOVE} > 0')} AS worsened, {_names(f'in_a AND in_b AND {_MOVE} < 0')} AS improved,
  count(CASE WHEN in_a AND in_b AND {_MOVE} > 0 THEN 1 END) AS n_worsened,
  count(CASE WHEN in_a AND in_b AND {_MOVE} = 0 THEN 1 END) AS stable_count
FROM pp GROUP BY table_name, pair_idx, from_ver, to_ver, from_rows, to_rows
""",
)
step(
    "c2",
    """
SELECT table_name, pair_idx, from_ver, to_ver, last_pair, column_name,
  CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'dropped' ELSE 'type_changed' END AS change,
  CASE WHEN in_a THEN a_cas_data_type || ' / ' || a_statistical_scale END AS from_type,
  CASE WHEN in_b THEN b_cas_data_type || ' / ' || b_statistical_scale END AS to_type,
  coalesce(b_completeness_percent, a_completeness_percent) AS completeness
FROM pp WHERE (in_a <> in_b) OR (in_a AND in_b AND (a_cas_data_type <> b_cas_data_type OR a_statistical_scale <> b_statistical_scale))
""",
)
step(
    "c3_ends",
    """
SELECT table_name, column_name, any_value(first_version) AS first_version, any_value(first_seq) AS first_seq,
  arg_min(completeness_percent, ver_idx) FILTER (WHERE present) AS first_comp,
  arg_max(completeness_percent, ver_idx) FILTER (WHERE present) AS last_comp,
  min(completeness_percent) AS low, max(completeness_percent) AS high,
  max(CASE WHEN ver_idx = 0 THEN completeness_percent END) AS at_start,
  max(CASE WHEN ver_idx = n_versions - 1 THEN completeness_percent END) AS at_end,
  arg_min(ver_name, ver_idx) FILTER (WHERE completeness_percent < 100) AS first_gap_version
FROM gridq GROUP BY table_name, column_name
""",
)
step(
    "c3",
    """
SELECT table_name, column_name, first_version, first_seq, first_comp, last_comp, first_gap_version,
  round(at_end - at_start, 1) AS net_delta,
  CASE WHEN first_comp IS NULL THEN 'absent' WHEN low = 100 THEN 'complete' WHEN high < 50 THEN 'sparse'
       WHEN first_comp = 100 AND last_comp < 100 THEN 'newly_missing'
       WHEN first_comp < 100 AND last_comp > first_comp + 5 THEN 'recovering'
       WHEN last_comp < first_comp - 5 THEN 'growing_missing'
       WHEN low < 100 AND abs(last_comp - first_comp) <= 5 THEN 'stable_missing' ELSE 'fluctuating' END AS missing_pattern
FROM c3_ends
""",
)
_C4_SCOPE = f"z_type = 'num' AND z_scale NOT IN ('id', 'binary', 'unary') AND lower(column_name) NOT IN {_TARGETS}"
step(
    "c4_flags",
    f"""
SELECT table_name, pair_idx, from_ver, to_ver, column_name, round(b_mean - a_mean, 4) AS mean_delta,
  round(raw_score, 3) AS drift_score, skew_flip, outlier_new,
  CASE WHEN raw_score > 0.5 OR skew_flip THEN 'critical' WHEN raw_score > 0.2::DOUBLE OR outlier_new THEN 'notable'
       ELSE 'stable' END AS severity
FROM (SELECT *, abs(b_mean - a_mean) / greatest(coalesce(a_std, 1), 1e-9) AS raw_score,
        coalesce(abs(b_skewness - a_skewness) > 0.5, false) AS skew_flip,
        coalesce(b_has_outliers AND NOT a_has_outliers, false) AS outlier_new
      FROM pp WHERE {_C4_SCOPE} AND a_data_type = 'num' AND b_data_type = 'num' AND a_mean IS NOT NULL AND b_mean IS NOT NULL) t
""",
)
step(
    "c4",
    f"""
SELECT s.table_name, s.column_name, s.scale, last_mean_delta, last_drift_score, last_severity,
  coalesce(flag_count, 0) AS flag_count, coalesce(overall_severity, 'stable') AS overall_severity
FROM (SELECT DISTINCT table_name, column_name, z_scale AS scale FROM gridq WHERE {_C4_SCOPE}) s
LEFT JOIN (SELECT table_name, column_name, arg_max(mean_delta, pair_idx) AS last_mean_delta,
             arg_max(drift_score, pair_idx) AS last_drift_score, arg_max(severity, pair_idx) AS last_severity,
             count(*) AS flag_count,
             CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'notable') THEN 'notable'
                  ELSE 'stable' END AS overall_severity
           FROM c4_flags GROUP BY table_name, column_name) f
  ON s.table_name = f.table_name AND s.column_name = f.column_name
""",
)
step(
    "c5_rates",
    """
SELECT g.table_name, g.column_name, ver_idx, ver_name, round(mean * 100, 2) AS event_rate,
  CASE WHEN mean > 0 THEN round((1 - mean) / mean, 2) END AS imbalance_ratio,
  CASE WHEN mean IS NOT NULL THEN round(coalesce(skewness, 0), 4) END AS skewness
FROM gridq g JOIN (
  SELECT table_name, arg_min(column_name, list_position(['target', 'bad', 'default', 'event', 'flag', 'label', 'y'], column_name)) AS column_name
  FROM gridq WHERE ver_idx = 0 AND present AND column_name IN ('target', 'bad', 'default', 'event', 'flag', 'label', 'y')
  GROUP BY table_name) t ON g.table_name = t.table_name AND g.column_name = t.column_name
""",
)
step(
    "c5",
    """
SELECT a.table_name, a.column_name, a.ver_idx AS pair_idx, a.ver_name AS from_ver, b.ver_name AS to_ver,
  round((b.event_rate - a.event_rate) / 100 * 100, 2) AS delta_pp,
  round(abs((b.event_rate - a.event_rate) / 100) * 100, 2) AS abs_delta_pp,
  CASE WHEN abs((b.event_rate - a.event_rate) / 100) >= 0.08::DOUBLE THEN 'critical'
       WHEN abs((b.event_rate - a.event_rate) / 100) >= 0.03::DOUBLE THEN 'notable' ELSE 'stable' END AS severity,
  abs((b.event_rate - a.event_rate) / 100) >= 0.03::DOUBLE AS back_test_required
FROM c5_rates a JOIN c5_rates b ON a.table_name = b.table_name AND a.column_name = b.column_name AND b.ver_idx = a.ver_idx + 1
WHERE a.event_rate IS NOT NULL AND b.event_rate IS NOT NULL
""",
)


def _trend(f: str, l: str, n: str, up: str, down: str) -> str:
    return f"CASE WHEN {n} < 2 THEN 'unknown' WHEN {l} > {f} THEN '{up}' WHEN {l} < {f} THEN '{down}' ELSE 'stable' END"


step(
    "c6",
    f"""
SELECT table_name, column_name, mismatch_first, mismatch_last, mismatch_max, blank_first, blank_last, blank_max,
  {_trend('mismatch_first', 'mismatch_last', 'n', 'regressing', 'improving')} AS mismatch_trend,
  {_trend('blank_first', 'blank_last', 'n', 'regressing', 'improving')} AS blank_trend
FROM (SELECT table_name, column_name, count(CASE WHEN present THEN 1 END) AS n,
        arg_min(mismatched_count, ver_idx) FILTER (WHERE present) AS mismatch_first,
        arg_max(mismatched_count, ver_idx) FILTER (WHERE present) AS mismatch_last, max(mismatched_count) AS mismatch_max,
        arg_min(blank_value_count, ver_idx) FILTER (WHERE present) AS blank_first,
        arg_max(blank_value_count, ver_idx) FILTER (WHERE present) AS blank_last, max(blank_value_count) AS blank_max
      FROM gridq GROUP BY table_name, column_name) t
WHERE mismatch_max > 0 OR blank_max > 0
""",
)
step(
    "c7",
    f"""
SELECT *, change_type IN ('worsened', 'dropped') AS highlight,
  row_number() OVER (PARTITION BY table_name ORDER BY change_type NOT IN ('worsened', 'dropped'), column_name) AS change_rank
FROM (SELECT *, CASE WHEN first_status = 'absent' THEN 'new' WHEN last_status = 'absent' THEN 'dropped'
          WHEN {_ORD.format('last_status')} > {_ORD.format('first_status')} THEN 'worsened'
          WHEN {_ORD.format('last_status')} < {_ORD.format('first_status')} THEN 'improved' ELSE 'stable' END AS change_type
  FROM (SELECT table_name, column_name, coalesce(max(CASE WHEN ver_idx = 0 THEN status END), 'absent') AS first_status,
          coalesce(max(CASE WHEN ver_idx = n_versions - 1 THEN status END), 'absent') AS last_status
        FROM gridq GROUP BY table_name, column_name) t) u
""",
)
step(
    "c8",
    f"""
SELECT *, CASE worst_label WHEN 'shift' THEN 0 WHEN 'monitor' THEN 1 WHEN 'stable' THEN 2 ELSE 3 END AS label_order
FROM (SELECT table_name, column_name, any_value(first_version) AS first_version, any_value(first_seq) AS first_seq,
        {_WORST} AS worst_label, max(psi) AS max_psi, arg_max(psi, pair_idx) FILTER (WHERE psi_applicable) AS last_psi
      FROM ppsi GROUP BY table_name, column_name) t
""",
)
step(
    "c8s",
    """
SELECT table_name, count(CASE WHEN worst_label = 'stable' THEN 1 END) AS stable_count,
  count(CASE WHEN worst_label = 'monitor' THEN 1 END) AS monitor_count,
  count(CASE WHEN worst_label = 'shift' THEN 1 END) AS shift_count,
  coalesce(string_agg(CASE WHEN worst_label = 'shift' THEN column_name END, ',' ORDER BY first_version, first_seq), '') AS critical_columns
FROM c8 GROUP BY table_name
""",
)
step(
    "c9",
    f"""
SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY NOT highlight, CASE WHEN worst_score = 0 THEN 100 ELSE worst_score END,
    first_version, first_seq) AS health_rank
FROM (SELECT *, worst_score < 40 OR trend = 'declining' AS highlight
  FROM (SELECT table_name, column_name, first_version, first_seq, first_score, last_score, worst_score,
          {_trend('first_score', 'last_score', 'n', 'improving', 'declining')} AS trend,
          CASE WHEN n >= 2 THEN round(last_score - first_score, 1) END AS delta
    FROM (SELECT table_name, column_name, any_value(first_version) AS first_version, any_value(first_seq) AS first_seq,
            count(score) AS n, arg_min(score, ver_idx) FILTER (WHERE present) AS first_score,
            arg_max(score, ver_idx) FILTER (WHERE present) AS last_score, min(score) AS worst_score
          FROM gridq GROUP BY table_name, column_name) t) u) w
""",
)
step(
    "c9d",
    """
SELECT *, CASE WHEN trend_slope IS NULL THEN 'insufficient_data' WHEN trend_slope > 1 THEN 'strongly_improving'
    WHEN trend_slope > 0.2 THEN 'improving' WHEN trend_slope < -1 THEN 'strongly_declining'
    WHEN trend_slope < -0.2 THEN 'declining' ELSE 'stable' END AS trend_direction,
  CASE WHEN n_versions >= 2 THEN round(last_score - first_score, 1) END AS score_delta
FROM (SELECT table_name, count(*) AS n_versions, arg_min(score, version) AS first_score, arg_max(score, version) AS last_score,
        arg_max(readiness_label, version) AS last_label,
        CASE WHEN count(*) >= 3 THEN round(regr_slope(score, x), 3) END AS trend_slope
      FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY version) - 1 AS x FROM s0l) t GROUP BY table_name) u
""",
)
step(
    "c10",
    """
SELECT * FROM (
  SELECT table_name, pair_idx, from_ver, to_ver, first_version, first_seq, column_name, coalesce(z_scale, 'nominal') AS scale,
    a_cardinality_count AS from_card, CASE WHEN b_cardinality_count > 0 THEN b_cardinality_count END AS to_card,
    CASE WHEN a_cardinality_count > 0 AND b_cardinality_count > 0 THEN round(b_cardinality_count / a_cardinality_count::DOUBLE, 2) END AS ratio,
    CASE WHEN a_cardinality_count > 0 AND b_cardinality_count > 0 THEN
           CASE WHEN b_cardinality_count / a_cardinality_count::DOUBLE >= 1.5 THEN 'critical'
                WHEN b_cardinality_count / a_cardinality_count::DOUBLE >= 1.2::DOUBLE THEN 'notable' END
         WHEN a_cardinality_count > 0 THEN 'dropped' END AS severity
  FROM pp) t WHERE severity IS NOT NULL
""",
)
step(
    "c0",
    """
SELECT table_name, verdict,
  CASE verdict WHEN 'BLOCK' THEN 'red' WHEN 'BACK_TEST_REQUIRED' THEN 'amber' WHEN 'MONITOR' THEN 'blue' ELSE 'green' END AS color,
  back_test_required, issue_count, target_moves, shift_count, shift_columns, degraded_pairs, first_score, last_score
FROM (SELECT *, CASE WHEN is_block THEN 'BLOCK' WHEN back_test_required THEN 'BACK_TEST_REQUIRED' WHEN issue_count > 0 THEN 'MONITOR'
          ELSE 'CLEAR' END AS verdict
  FROM (SELECT *, target_moves + CASE WHEN shift_count > 0 THEN 1 ELSE 0 END + degraded_pairs
          + CASE WHEN is_block OR fell_far OR (last_score < first_score - 8 AND NOT back_test_required) THEN 1 ELSE 0 END AS issue_count
    FROM (SELECT *, target_moves > 0 OR shift_count > 0 OR degraded_pairs > 0 OR fell_far AS back_test_required
      FROM (SELECT d.table_name, d.first_score, d.last_score, d.n_versions >= 2 AND d.last_score < 40 AS is_block,
              d.n_versions >= 2 AND d.last_score >= 40 AND d.last_score < d.first_score - 15 AS fell_far,
              (SELECT count(*) FROM c5 WHERE c5.table_name = d.table_name AND back_test_required) AS target_moves,
              (SELECT count(*) FROM c1 WHERE c1.table_name = d.table_name AND n_worsened >= 2) AS degraded_pairs,
              coalesce(s.shift_count, 0) AS shift_count,
              coalesce(s.critical_columns, '') AS shift_columns
            FROM c9d d LEFT JOIN c8s s ON d.table_name = s.table_name) t) u) v) w
""",
)
