"""Tables, profile and single-version steps."""

from oracle import step

# ── modelling tables ────────────────────────────────────────────────────────────────────────────
step(
    "line_facts",
    """
SELECT l_orderkey, count(*) AS n_lines, round(avg(l_discount), 6) AS avg_discount,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS target
FROM lineitem GROUP BY l_orderkey
""",
)
step(
    "steady",
    """
SELECT CAST(year(o_orderdate) AS INTEGER) AS version, o_orderkey AS order_id, o_totalprice AS total_price,
       c_acctbal AS acct_balance, n_lines, avg_discount, c_mktsegment AS segment,
       o_orderpriority AS priority, o_orderstatus AS order_status, target
FROM orders LEFT JOIN line_facts ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
""",
)
step(
    "mutated",
    """
SELECT version, order_id,
       CASE WHEN version >= 1999 THEN total_price * 1.3::DOUBLE ELSE total_price END AS total_price,
       CASE WHEN version >= 1998 AND order_id % 10 = 0 THEN NULL
            WHEN version >= 2001 THEN acct_balance * 2 ELSE acct_balance END AS acct_balance,
       CASE WHEN version >= 2000 AND order_id % 10 < 6 THEN NULL ELSE n_lines END AS n_lines,
       avg_discount,
       CASE WHEN version >= 1999 AND order_id % 20 = 0 THEN '' ELSE segment END AS segment,
       CASE WHEN version >= 2000 THEN priority || CAST(order_id % 4 AS VARCHAR) ELSE priority END AS priority,
       order_status,
       CASE WHEN version >= 2000 AND order_id % 5 = 0 THEN 0 ELSE target END AS target,
       1 AS const
FROM steady
""",
)
step("event_rows", "SELECT *, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS version FROM events")
step(
    "doc_rows",
    "SELECT *, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS version FROM documents",
)

# (table, relation, condition, columns as (name, kind, type))
_ORDERS = [
    ("order_id", "num", "bigint"), ("total_price", "num", "double"), ("acct_balance", "num", "double"),
    ("n_lines", "num", "bigint"), ("avg_discount", "num", "double"), ("segment", "char", "string"),
    ("priority", "char", "string"), ("order_status", "char", "string"), ("target", "num", "int"),
]
TABLES = {
    "abt_orders": ("mutated", [*_ORDERS, ("const", "num", "int")]),
    "abt_steady": ("steady", _ORDERS),
    "events": ("event_rows", [
        ("event_id", "num", "bigint"), ("user_id", "num", "bigint"), ("event_type", "char", "string"),
        ("value", "num", "double"), ("props", "char", "string"), ("ts", "num", "timestamp_ntz"), ("detail", "other", "struct<k:int>"),
    ]),
    "documents": ("doc_rows", [
        ("doc_id", "num", "bigint"), ("text", "char", "string"), ("lang", "char", "string"),
        ("source", "char", "string"), ("n_chars", "num", "bigint"),
    ]),
}
_PRESENT = {("abt_orders", "const"): "version >= 2000", ("abt_orders", "order_status"): "version < 2001"}

_EXPRESSIONS = {("events", "ts"): "(epoch_us(ts) / 1e6::DOUBLE)", ("events", "detail"): "(CASE WHEN user_id % 7 <> 0 THEN props END)"}

_cells = []
for _table, (_relation, _columns) in TABLES.items():
    for _seq, (_name, _kind, _type) in enumerate(_columns):
        _source = _EXPRESSIONS.get((_table, _name), _name)
        _num = f"CAST({_source} AS DOUBLE)" if _kind == "num" else "CAST(NULL AS DOUBLE)"
        _txt = f"CAST({_name} AS VARCHAR)" if _kind == "char" else "CAST(NULL AS VARCHAR)"
        _cells.append(
            f"SELECT '{_table}' AS table_name, version, {_seq} AS col_seq, '{_name}' AS column_name, "
            f"'{_kind}' AS data_type, '{_type}' AS cas_data_type, {_num} AS num, {_txt} AS txt, {_source} IS NOT NULL AS has "
            f"FROM {_relation} WHERE {_PRESENT.get((_table, _name), 'true')}"
        )
step("cells", "\nUNION ALL ".join(_cells))

step(
    "declared",
    """
SELECT * FROM (VALUES
  ('abt_orders', 'order_id', 'id', NULL, NULL), ('abt_orders', 'acct_balance', 'interval', 'private', NULL),
  ('abt_orders', 'n_lines', 'interval', NULL, NULL), ('abt_orders', 'priority', 'nominal', NULL, '^[1-5]-[A-Z ]+$'),
  ('abt_steady', 'order_id', 'id', NULL, NULL), ('abt_steady', 'n_lines', 'interval', NULL, NULL),
  ('events', 'event_id', 'id', NULL, NULL), ('events', 'user_id', 'nominal', 'private', NULL),
  ('events', 'props', 'nominal', NULL, '^\\{"k": [0-9]{2}\\}$'),
  ('documents', 'doc_id', 'id', NULL, NULL), ('documents', 'n_chars', 'interval', NULL, NULL)
) AS t(table_name, column_name, given_scale, information_privacy, pattern)
""",
)

# ── profile ─────────────────────────────────────────────────────────────────────────────────────
step(
    "basic",
    """
SELECT table_name, version, column_name, min(col_seq) AS col_seq, min(data_type) AS data_type,
       min(cas_data_type) AS cas_data_type, count(*) AS row_count,
       count(CASE WHEN has THEN 1 END) AS n_present,
       CASE min(data_type) WHEN 'num' THEN count(DISTINCT num) WHEN 'char' THEN count(DISTINCT txt) END AS cardinality_count,
       min(num) AS min_val, max(num) AS max_val, avg(num) AS mean, stddev_samp(num) AS std,
       stddev_pop(num) AS sdp,
       quantile_cont(num, 0.25) AS q25, quantile_cont(num, 0.5) AS q50, quantile_cont(num, 0.75) AS q75,
       count(CASE WHEN trim(txt) = '' THEN 1 END) AS blank_value_count,
       max(length(txt)) AS chars_max_count, min(length(txt)) AS chars_min_count
FROM cells GROUP BY table_name, version, column_name
""",
)
step(
    "shape",
    """
SELECT c.table_name, c.version, c.column_name,
       avg(power(num - mean, 3)) / nullif(power(any_value(sdp), 3), 0) AS skewness,
       avg(power(num - mean, 4)) / nullif(power(any_value(sdp), 4), 0) - 3 AS kurtosis,
       count(CASE WHEN num < q25 - 1.5 * (q75 - q25) OR num > q75 + 1.5 * (q75 - q25) THEN 1 END) AS n_outliers,
       count(CASE WHEN pattern IS NOT NULL AND trim(txt) <> '' AND NOT regexp_matches(txt, pattern) THEN 1 END)
         AS mismatched_count
FROM cells c JOIN basic b ON c.table_name = b.table_name AND c.version = b.version AND c.column_name = b.column_name
     LEFT JOIN declared d ON c.table_name = d.table_name AND c.column_name = d.column_name
GROUP BY c.table_name, c.version, c.column_name
""",
)
step(
    "prof",
    """
SELECT b.table_name, b.version, b.table_name || '_v' || b.version AS abt_name, row_count, col_seq, b.column_name,
       data_type, cas_data_type,
       coalesce(given_scale, CASE WHEN data_type = 'other' THEN 'nested' WHEN cardinality_count <= 1 THEN 'unary' WHEN cardinality_count = 2 THEN 'binary'
         WHEN cardinality_count = row_count AND (data_type = 'char' OR cas_data_type IN ('int', 'bigint')) THEN 'id'
         WHEN data_type = 'char' THEN 'nominal' ELSE 'interval' END) AS statistical_scale,
       100.0::DOUBLE * n_present / row_count AS completeness_percent, row_count - n_present AS missing_count,
       cardinality_count, 100.0::DOUBLE * cardinality_count / row_count AS uniqueness_percent,
       mean, std, min_val, max_val, skewness, kurtosis, q25, q50, q75,
       n_outliers > 0 AS has_outliers, n_outliers, blank_value_count, mismatched_count, chars_max_count,
       chars_min_count, information_privacy,
       cardinality_count = row_count AND (data_type = 'char' OR cas_data_type IN ('int', 'bigint')) AS has_unique_field
FROM basic b JOIN shape s ON b.table_name = s.table_name AND b.version = s.version AND b.column_name = s.column_name
     LEFT JOIN declared d ON b.table_name = d.table_name AND b.column_name = d.column_name
""",
)

# ── rules and scores ────────────────────────────────────────────────────────────────────────────
step(
    "flagged",
    """
SELECT *, mismatched_count / row_count::DOUBLE AS mismatch_rate,
       completeness_percent < 50 AS b_missing,
       coalesce(cardinality_count <= 1, false) OR statistical_scale = 'unary' AS b_zero,
       mismatched_count / row_count::DOUBLE > 0.15::DOUBLE AS b_mismatch,
       has_unique_field OR statistical_scale = 'id' OR coalesce(uniqueness_percent >= 99.9::DOUBLE, false) AS g_identifier,
       coalesce(information_privacy = 'private', false) AS g_privacy,
       lower(column_name) IN ('target', 'bad', 'default', 'event', 'flag', 'label', 'y') AS is_target,
       coalesce(data_type = 'num' AND statistical_scale NOT IN ('binary', 'id', 'unary') AND min_val >= 0
         AND max_val <= 1 AND cardinality_count >= 50
         AND lower(column_name) NOT IN ('target', 'bad', 'default', 'event', 'flag', 'label', 'y'), false) AS prob_like
FROM prof
""",
)
step(
    "subscores",
    """
SELECT *, b_missing OR b_zero OR b_mismatch AS blocked,
       completeness_percent / 100 AS u_c,
       CASE WHEN b_zero OR statistical_scale = 'id' THEN 0 WHEN cardinality_count IS NULL THEN 1
            WHEN data_type = 'num'
              THEN least(1, coalesce(std, 0) / greatest(abs(coalesce(max_val, 0) - coalesce(min_val, 0)), 1e-9) * 4)
            ELSE greatest(0, 1 - greatest(0, (1 - uniqueness_percent / 100 / greatest(cardinality_count, 1)) - 0.7::DOUBLE) * 3)
       END AS u_v,
       greatest(0, 1 - (mismatch_rate + blank_value_count / row_count::DOUBLE) * 5) AS u_m,
       greatest(0, 1 - (CASE WHEN has_unique_field OR statistical_scale = 'id' THEN 0.6::DOUBLE ELSE 0::DOUBLE END
         + CASE WHEN g_privacy THEN 0.3::DOUBLE ELSE 0::DOUBLE END + CASE WHEN prob_like THEN 0.5::DOUBLE ELSE 0::DOUBLE END)) AS u_g,
       CASE WHEN data_type = 'num' AND skewness IS NOT NULL AND statistical_scale NOT IN ('id', 'binary', 'unary')
            THEN greatest(0, 1 - least(abs(skewness), 3) / 3 * 0.5::DOUBLE - n_outliers / row_count::DOUBLE * 5)
            ELSE 1 END AS u_d
FROM flagged
""",
)
step(
    "parts",
    """
SELECT *,
       round((u_c * 0.35::DOUBLE + u_v * 0.2::DOUBLE + u_m * 0.2::DOUBLE + u_g * 0.15::DOUBLE + u_d * 0.1::DOUBLE) * 100, 1) AS score,
       round(u_c * 100, 1) AS p_completeness, round(u_v * 100, 1) AS p_variance, round(u_m * 100, 1) AS p_mismatch,
       round(u_g * 100, 1) AS p_governance, round(u_d * 100, 1) AS p_distribution,
       NOT blocked AND completeness_percent < 100 AS w_partial,
       NOT blocked AND mismatched_count > 0 AS w_format,
       NOT blocked AND blank_value_count > 0 AS w_blank,
       g_identifier OR g_privacy OR prob_like AS governed,
       data_type = 'num' AND NOT blocked AND statistical_scale NOT IN ('id', 'binary', 'unary')
         AND skewness IS NOT NULL AS has_shape
FROM subscores
""",
)
step(
    "sc",
    """
SELECT *, w_partial OR w_format OR w_blank AS warned,
       CASE WHEN blocked THEN 'drop' WHEN governed OR w_partial OR w_format OR w_blank THEN 'caution' ELSE 'ready' END AS status,
       CASE WHEN score >= 80 THEN 'good' WHEN score >= 55 THEN 'fair' WHEN score >= 30 THEN 'poor' ELSE 'critical' END
         AS health_label,
       CASE least(p_completeness, p_variance, p_mismatch, p_governance, p_distribution)
         WHEN p_completeness THEN 'completeness' WHEN p_variance THEN 'variance' WHEN p_mismatch THEN 'mismatch'
         WHEN p_governance THEN 'governance' ELSE 'distribution' END AS worst_dim
FROM parts
""",
)
step(
    "rule_rows",
    """
SELECT table_name, version, col_seq, column_name, 0 AS source, 0 AS seq, 'high_missing' AS rule FROM sc WHERE b_missing
UNION ALL SELECT table_name, version, col_seq, column_name, 0, 1, 'zero_variance' FROM sc WHERE b_zero
UNION ALL SELECT table_name, version, col_seq, column_name, 0, 2, 'severe_mismatch' FROM sc WHERE b_mismatch
UNION ALL SELECT table_name, version, col_seq, column_name, 1, 3, 'IDENTIFIER' FROM sc WHERE g_identifier
UNION ALL SELECT table_name, version, col_seq, column_name, 1, 4, 'PRIVACY' FROM sc WHERE g_privacy
UNION ALL SELECT table_name, version, col_seq, column_name, 1, 5, 'LEAKAGE' FROM sc WHERE prob_like
UNION ALL SELECT table_name, version, col_seq, column_name, 2, 6, 'partial_missing' FROM sc WHERE w_partial
UNION ALL SELECT table_name, version, col_seq, column_name, 2, 7, 'format_mismatch' FROM sc WHERE w_format
""",
)
step(
    "action_rows",
    """
SELECT * FROM rule_rows
UNION ALL
SELECT table_name, version, col_seq, column_name, 3, 8,
       CASE WHEN abs(coalesce(skewness, 0)) > 1 THEN 'transform' ELSE 'winsorise' END
FROM sc s WHERE NOT is_target AND score < 55 AND worst_dim = 'distribution' AND data_type = 'num'
  AND (abs(coalesce(skewness, 0)) > 1 OR n_outliers > 0)
  AND NOT EXISTS (SELECT 1 FROM rule_rows r WHERE r.table_name = s.table_name AND r.version = s.version
                  AND r.column_name = s.column_name)
""",
)
step(
    "action_dim",
    """
SELECT * FROM (VALUES ('zero_variance', 'CRITICAL', 9, 'low', 36), ('high_missing', 'CRITICAL', 8, 'medium', 32),
  ('severe_mismatch', 'CRITICAL', 8, 'medium', 32), ('LEAKAGE', 'CRITICAL', 10, 'low', 40),
  ('IDENTIFIER', 'HIGH', 9, 'low', 27), ('PRIVACY', 'HIGH', 6, 'high', 18), ('partial_missing', 'MEDIUM', 5, 'medium', 10),
  ('format_mismatch', 'MEDIUM', 5, 'low', 10), ('transform', 'MEDIUM', 4, 'low', 8), ('winsorise', 'MEDIUM', 4, 'low', 8)
) AS t(rule, severity, impact, effort, priority_score)
""",
)
step(
    "s0",
    """
SELECT table_name, version, any_value(abt_name) AS abt_name,
       CASE WHEN sum(w) > 0 THEN round(sum(round(v * w * 20)) / 20.0::DOUBLE / sum(w), 1) ELSE 0 END AS score,
       count(*) AS total_cols,
       count(CASE WHEN NOT is_target THEN 1 END) AS feature_cols,
       count(CASE WHEN NOT is_target AND status = 'drop' THEN 1 END) AS blocked_cols,
       count(CASE WHEN NOT is_target AND status = 'caution' THEN 1 END) AS caution_cols,
       count(CASE WHEN NOT is_target AND status = 'ready' THEN 1 END) AS ready_cols,
       count(CASE WHEN is_target THEN 1 END) AS target_cols
FROM (SELECT *, CASE WHEN is_target THEN 0::DOUBLE WHEN status = 'caution' THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS w,
             CASE WHEN status = 'drop' THEN 0::DOUBLE ELSE score END AS v FROM sc) t
GROUP BY table_name, version
""",
)
step(
    "s0l",
    """
SELECT *, CASE WHEN score >= 80 THEN 'ready' WHEN score >= 65 THEN 'mostly_ready' WHEN score >= 45 THEN 'needs_work'
          ELSE 'not_ready' END AS readiness_label FROM s0
""",
)
step(
    "target_pick",
    """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY table_name, version
    ORDER BY list_position(['target', 'bad', 'default', 'event', 'flag', 'label', 'y'], column_name)) AS rn
  FROM sc WHERE column_name IN ('target', 'bad', 'default', 'event', 'flag', 'label', 'y')) t WHERE rn = 1
""",
)
step(
    "s6",
    """
SELECT table_name, version, column_name, cardinality_count, statistical_scale, row_count, blocked,
       round(mean * 100, 2) AS event_rate, round((1 - mean) * 100, 2) AS non_event_rate,
       CASE WHEN mean > 0 THEN round((1 - mean) / mean, 2) END AS imbalance_ratio,
       CASE WHEN mean IS NULL THEN NULL WHEN NOT mean > 0 THEN 'unknown'
            WHEN round((1 - mean) / mean, 2) < 1.5 THEN 'balanced'
            WHEN round((1 - mean) / mean, 2) < 4 THEN 'moderate' ELSE 'severe' END AS balance_label,
       CASE WHEN mean IS NOT NULL THEN round(coalesce(skewness, 0), 4) END AS skewness,
       completeness_percent AS completeness,
       CASE WHEN mean IS NULL THEN 'no statistics for the target column' END AS error
FROM target_pick
""",
)
step(
    "s7",
    """
SELECT table_name, version, column_name, statistical_scale, min_val, max_val, q25, q50, q75,
       round(skewness, 4) AS skewness, has_outliers, n_outliers,
       CASE WHEN abs(skewness) < 0.5 THEN 'symmetric' WHEN skewness > 1 THEN 'right-skewed'
            WHEN skewness < -1 THEN 'left-skewed' ELSE 'mild skew' END AS skew_label,
       greatest(q50 - q25, q75 - q50) / CASE WHEN least(q50 - q25, q75 - q50) > 0 THEN least(q50 - q25, q75 - q50)
         ELSE 0.0001::DOUBLE END < 1.5 AS iqr_symmetric,
       coalesce(min_val >= 0 AND max_val <= 1 AND cardinality_count >= 50, false) AS bounded_unit
FROM sc WHERE has_shape
""",
)
