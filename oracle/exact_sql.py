"""Exact drift steps over the rows of both versions of a pair."""

from oracle import step

step(
    "keyed",
    """
SELECT c.table_name, c.column_name, v.ver_idx, c.num, c.txt, count(*) AS cnt
FROM cells c JOIN vers v ON c.table_name = v.table_name AND c.version = v.version
WHERE c.num IS NOT NULL OR c.txt IS NOT NULL GROUP BY 1, 2, 3, 4, 5
""",
)
step(
    "ent",
    """
SELECT k.table_name, k.column_name, k.ver_idx, -sum(cnt / n * log2(cnt / n)) AS entropy
FROM keyed k JOIN (SELECT table_name, column_name, ver_idx, sum(cnt)::DOUBLE AS n FROM keyed GROUP BY 1, 2, 3) t
  ON k.table_name = t.table_name AND k.column_name = t.column_name AND k.ver_idx = t.ver_idx GROUP BY 1, 2, 3
""",
)
step(
    "d6x",
    """
SELECT *, CASE WHEN entropy_change >= 0.35::DOUBLE THEN 'critical' WHEN entropy_change >= 0.15::DOUBLE THEN 'notable'
  WHEN entropy_change IS NOT NULL THEN 'stable' END AS severity
FROM (SELECT p.table_name, p.column_name, p.pair_idx, a.entropy AS entropy_base, b.entropy AS entropy_new,
    CASE WHEN a.entropy >= 1e-9 THEN abs(b.entropy - a.entropy) / a.entropy END AS entropy_change
  FROM pp p JOIN ent a ON a.table_name = p.table_name AND a.column_name = p.column_name AND a.ver_idx = p.pair_idx
    JOIN ent b ON b.table_name = p.table_name AND b.column_name = p.column_name AND b.ver_idx = p.pair_idx + 1
  WHERE p.in_b AND (p.a_data_type = 'char' OR p.a_statistical_scale = 'binary')) t
""",
)
step(
    "both_sides",
    """
SELECT p.table_name, p.column_name, p.pair_idx, k.num, k.txt, sum(CASE WHEN k.ver_idx = p.pair_idx THEN cnt ELSE 0 END) AS ca,
  sum(CASE WHEN k.ver_idx = p.pair_idx + 1 THEN cnt ELSE 0 END) AS cb
FROM pp p JOIN keyed k ON k.table_name = p.table_name AND k.column_name = p.column_name AND k.ver_idx IN (p.pair_idx, p.pair_idx + 1)
GROUP BY 1, 2, 3, 4, 5
""",
)
step(
    "d7x",
    """
SELECT *, CASE WHEN ks >= 0.2::DOUBLE THEN 'critical' WHEN ks >= 0.1::DOUBLE THEN 'notable' ELSE 'stable' END AS severity
FROM (SELECT table_name, column_name, pair_idx, max(abs(fa - fb)) AS ks
  FROM (SELECT s.table_name, s.column_name, s.pair_idx, sum(ca) OVER w / sum(ca) OVER g::DOUBLE AS fa, sum(cb) OVER w / sum(cb) OVER g::DOUBLE AS fb,
      sum(ca) OVER g AS na, sum(cb) OVER g AS nb
    FROM both_sides s JOIN pp p ON s.table_name = p.table_name AND s.column_name = p.column_name AND s.pair_idx = p.pair_idx
    WHERE s.num IS NOT NULL AND p.a_data_type = 'num' AND p.b_data_type = 'num' AND p.z_scale NOT IN ('id', 'unary')
    WINDOW w AS (PARTITION BY s.table_name, s.column_name, s.pair_idx ORDER BY s.num),
      g AS (PARTITION BY s.table_name, s.column_name, s.pair_idx)) t WHERE na > 0 AND nb > 0 GROUP BY 1, 2, 3) u
""",
)
_BINS = ["s.num <= a_q25", "s.num > a_q25 AND s.num <= a_q50", "s.num > a_q50 AND s.num <= a_q75", "s.num > a_q75"]
_SHARES = ", ".join(
    f"greatest(sum(CASE WHEN {b} THEN {c} ELSE 0 END) / sum({c})::DOUBLE, 1e-6) AS {c}{i}"
    for c in ("ca", "cb")
    for i, b in enumerate(_BINS)
)
_LABEL = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'monitor' ELSE 'shift' END AS psi_label"
step(
    "d8x",
    f"""
SELECT *, {_LABEL} FROM (SELECT table_name, column_name, pair_idx, {' + '.join(f'(cb{i} - ca{i}) * ln(cb{i} / ca{i})' for i in range(4))} AS psi
  FROM (SELECT s.table_name, s.column_name, s.pair_idx, {_SHARES}
    FROM both_sides s JOIN pp p ON s.table_name = p.table_name AND s.column_name = p.column_name AND s.pair_idx = p.pair_idx
    WHERE s.num IS NOT NULL AND p.a_data_type = 'num' AND p.b_data_type = 'num' AND p.a_statistical_scale NOT IN ('id', 'binary', 'unary')
      AND p.a_q50 IS NOT NULL AND p.b_q50 IS NOT NULL GROUP BY 1, 2, 3) t) u
""",
)
step(
    "d9x",
    f"""
SELECT *, {_LABEL} FROM (SELECT table_name, column_name, pair_idx, count(*) AS categories, sum((pb - pa) * ln(pb / pa)) AS psi
  FROM (SELECT s.table_name, s.column_name, s.pair_idx, CASE WHEN ca > 0 THEN ca / sum(ca) OVER g::DOUBLE ELSE least(1e-6, 0.5 / sum(ca) OVER g) END AS pa, CASE WHEN cb > 0 THEN cb / sum(cb) OVER g::DOUBLE ELSE least(1e-6, 0.5 / sum(cb) OVER g) END AS pb
    FROM both_sides s JOIN pp p ON s.table_name = p.table_name AND s.column_name = p.column_name AND s.pair_idx = p.pair_idx
    WHERE s.txt IS NOT NULL AND p.a_data_type = 'char' AND p.b_data_type = 'char' AND p.a_statistical_scale NOT IN ('id', 'unary')
    WINDOW g AS (PARTITION BY s.table_name, s.column_name, s.pair_idx)) t GROUP BY 1, 2, 3) u
""",
)
step(
    "deciles",
    """
SELECT c.table_name, c.column_name, v.ver_idx AS pair_idx, quantile_cont(c.num, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts
FROM cells c JOIN vers v ON c.table_name = v.table_name AND c.version = v.version WHERE c.num IS NOT NULL GROUP BY 1, 2, 3
""",
)
step(
    "d8d",
    f"""
SELECT *, {_LABEL} FROM (SELECT table_name, column_name, pair_idx, sum((pb - pa) * ln(pb / pa)) AS psi
  FROM (SELECT *, greatest(a / sum(a) OVER g::DOUBLE, 1e-6) AS pa, greatest(b / sum(b) OVER g::DOUBLE, 1e-6) AS pb
    FROM (SELECT s.table_name, s.column_name, s.pair_idx, len(list_filter(d.cuts, lambda e: e < s.num)) AS bin, sum(ca) AS a, sum(cb) AS b
      FROM both_sides s JOIN pp p ON s.table_name = p.table_name AND s.column_name = p.column_name AND s.pair_idx = p.pair_idx
        JOIN deciles d ON s.table_name = d.table_name AND s.column_name = d.column_name AND s.pair_idx = d.pair_idx
      WHERE s.num IS NOT NULL AND p.a_data_type = 'num' AND p.b_data_type = 'num' AND p.a_statistical_scale NOT IN ('id', 'binary', 'unary')
        AND p.a_q50 IS NOT NULL AND p.b_q50 IS NOT NULL GROUP BY 1, 2, 3, 4) t
    WINDOW g AS (PARTITION BY table_name, column_name, pair_idx)) u GROUP BY 1, 2, 3) w
""",
)
