"""Single-version analysis over every table and version of a profile at once.

``scored`` computes all rule flags and scores of a column in one projection; the sections are
projections, explodes and small aggregates of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve import vocab
from varve.config import Thresholds
from varve.functions import text
from varve.functions.scalars import is_target, keep_when, num, safe, target_rank

VERSION = ["table_name", "version"]
DIMENSIONS = ["completeness", "variance", "mismatch", "governance", "distribution"]


def _in_scales(scales: list[str]) -> Column:
    return F.coalesce(F.col("statistical_scale").isin(*scales), F.lit(False))


def prob_like(cfg: Thresholds) -> Column:
    """Numeric, inside [0, 1], many values, not a label: looks like a model score."""
    return F.coalesce(
        (F.col("data_type") == "num")
        & ~_in_scales(["binary", "id", "unary"])
        & (F.col("min_val") >= 0)
        & (F.col("max_val") <= 1)
        & (F.col("cardinality_count") >= cfg.leakage_cardinality)
        & ~is_target(F.col("column_name")),
        F.lit(False),
    )


def _flags(cfg: Thresholds) -> dict[str, Column]:
    rows = F.greatest(F.col("row_count"), F.lit(1))
    return {
        "rows": rows,
        "mismatch_rate": F.col("mismatched_count") / rows,
        "b_missing": F.col("completeness_percent") < cfg.blocker_completeness,
        "b_zero": F.coalesce(F.col("cardinality_count") <= 1, F.lit(False)) | _in_scales(["unary"]),
        "b_mismatch": F.col("mismatched_count") / rows > cfg.blocker_mismatch_rate,
        "g_identifier": F.coalesce(F.col("has_unique_field"), F.lit(False))
        | _in_scales(["id"])
        | F.coalesce(F.col("uniqueness_percent") >= 99.9, F.lit(False)),
        "g_privacy": F.coalesce(F.col("information_privacy") == "private", F.lit(False)),
        "prob_like": prob_like(cfg),
    }


def _subscores() -> dict[str, Column]:
    numeric = F.col("data_type") == "num"
    spread = safe(F.col("std")) / F.greatest(
        F.abs(safe(F.col("max_val")) - safe(F.col("min_val"))), F.lit(1e-9)
    )
    dominance = 1.0 - F.col("uniqueness_percent") / 100.0 / F.greatest(F.col("cardinality_count"), F.lit(1))
    variance = (
        F.when(F.col("b_zero") | _in_scales(["id"]), 0.0)
        .when(F.col("cardinality_count").isNull(), 1.0)
        .when(numeric, F.least(F.lit(1.0), spread * 4))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), dominance - 0.7) * 3.0))
    )
    bad_rate = F.col("mismatch_rate") + F.col("blank_value_count") / F.col("rows")
    unique = F.coalesce(F.col("has_unique_field"), F.lit(False)) | _in_scales(["id"])
    penalty = (
        F.when(unique, 0.6).otherwise(0.0)
        + F.when(F.col("g_privacy"), 0.3).otherwise(0.0)
        + F.when(F.col("prob_like"), 0.5).otherwise(0.0)
    )
    shaped = numeric & F.col("skewness").isNotNull() & ~_in_scales(vocab.NON_DISTRIBUTION_SCALES)
    distribution = F.when(
        shaped,
        F.greatest(
            F.lit(0.0),
            1.0
            - F.least(F.abs(safe(F.col("skewness"))), F.lit(3.0)) / 3.0 * 0.5
            - F.col("n_outliers") / F.col("rows") * 5,
        ),
    ).otherwise(1.0)
    return {
        "u_completeness": F.col("completeness_percent") / 100.0,
        "u_variance": variance,
        "u_mismatch": F.greatest(F.lit(0.0), 1.0 - bad_rate * 5),
        "u_governance": F.greatest(F.lit(0.0), 1.0 - penalty),
        "u_distribution": distribution,
    }


def scored(profiles: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """Profile plus rule flags, readiness status, health score and its parts."""
    blocked = F.col("b_missing") | F.col("b_zero") | F.col("b_mismatch")
    weights = dict(
        zip(DIMENSIONS, [cfg.w_completeness, cfg.w_variance, cfg.w_mismatch, cfg.w_governance, cfg.w_distribution])
    )
    raw = sum((F.col(f"u_{d}") * w for d, w in weights.items()), F.lit(0.0))
    parts = {f"p_{d}": F.round(F.col(f"u_{d}") * 100, 1) for d in DIMENSIONS}
    low = F.least(*[F.col(f"p_{d}") for d in DIMENSIONS])
    worst = F.coalesce(*[F.when(F.col(f"p_{d}") == low, d) for d in DIMENSIONS])
    df = (
        profiles.withColumns(_flags(cfg))
        .withColumns(_subscores())
        .withColumns({"blocked": blocked, "score": F.round(raw * 100, 1), **parts})
        .withColumns(
            {
                "w_partial": ~F.col("blocked") & (F.col("completeness_percent") < 100),
                "w_format": ~F.col("blocked") & (F.col("mismatched_count") > 0),
                "w_blank": ~F.col("blocked") & (F.col("blank_value_count") > 0),
                "governed": F.col("g_identifier") | F.col("g_privacy") | F.col("prob_like"),
                "is_target": is_target(F.col("column_name")),
                "health_label": F.when(F.col("score") >= 80, "good")
                .when(F.col("score") >= 55, "fair")
                .when(F.col("score") >= 30, "poor")
                .otherwise("critical"),
                "worst_dim": worst,
                "has_shape": (F.col("data_type") == "num")
                & ~F.col("blocked")
                & ~_in_scales(vocab.NON_DISTRIBUTION_SCALES)
                & F.col("skewness").isNotNull(),
            }
        )
        .withColumn("warned", F.col("w_partial") | F.col("w_format") | F.col("w_blank"))
        .withColumn(
            "status",
            F.when(F.col("blocked"), "drop").when(F.col("governed") | F.col("warned"), "caution").otherwise("ready"),
        )
    )
    return df.drop("rows", *[f"u_{d}" for d in DIMENSIONS])


# ── sections ────────────────────────────────────────────────────────────────────────────────────


def health_summary(sc: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """Counts and overall health per version."""
    issues = F.col("high_missing") + F.col("zero_variance") + F.col("has_mismatches")
    return (
        sc.groupBy(*VERSION)
        .agg(
            F.max("abt_name").alias("abt_name"),
            F.max("snapshot_date").alias("snapshot_date"),
            F.max("row_count").alias("row_count"),
            F.count(F.lit(1)).alias("total_columns"),
            F.count_if(F.col("completeness_percent") == 100).alias("fully_complete"),
            F.count_if("b_missing").alias("high_missing"),
            F.count_if("g_privacy").alias("privacy_flagged"),
            F.count_if("b_zero").alias("zero_variance"),
            F.count_if(F.col("mismatched_count") > 0).alias("has_mismatches"),
        )
        .withColumn(
            "overall_health",
            F.when((issues == 0) & (F.col("privacy_flagged") == 0), "healthy")
            .when(issues <= 3, "caution")
            .otherwise("critical"),
        )
    )


def _rules(sc: DataFrame, name: str, *pairs: tuple[str, str]) -> DataFrame:
    fired = keep_when(*[(F.col(flag), F.lit(rule)) for flag, rule in pairs])
    return (
        sc.select("*", F.posexplode(fired).alias("rule_seq", name))
        .withColumn("action", text.lookup(F.col(name), text.RULE_ACTIONS))
    )


def blockers(sc: DataFrame) -> DataFrame:
    """One row per column and blocking rule."""
    detail = (
        F.when(
            F.col("rule") == "high_missing",
            F.concat(num(F.col("completeness_percent"), 1), F.lit("% complete, missing rows: "), F.col("missing_count")),
        )
        .when(F.col("rule") == "zero_variance", F.concat(F.lit("distinct values: "), F.col("cardinality_count")))
        .otherwise(F.concat(F.lit("mismatched rows: "), F.col("mismatched_count")))
    )
    return (
        _rules(sc, "rule", ("b_missing", "high_missing"), ("b_zero", "zero_variance"), ("b_mismatch", "severe_mismatch"))
        .withColumn("detail", detail)
        .select(
            *VERSION, "col_seq", "column_name", "statistical_scale", "data_type", "completeness_percent",
            "missing_count", "cardinality_count", "mismatched_count", "mismatch_rate", "rule_seq", "rule",
            "detail", "action",
        )
    )


def warnings(sc: DataFrame) -> DataFrame:
    """S3: quality warnings of columns that are not blocked."""
    detail = (
        F.when(
            F.col("issue") == "partial_missing",
            F.concat(num(100 - F.col("completeness_percent"), 1), F.lit("% missing, rows: "), F.col("missing_count")),
        )
        .when(F.col("issue") == "format_mismatch", F.concat(F.lit("mismatched rows: "), F.col("mismatched_count")))
        .otherwise(F.concat(F.lit("blank values: "), F.col("blank_value_count")))
    )
    return (
        _rules(sc, "issue", ("w_partial", "partial_missing"), ("w_format", "format_mismatch"), ("w_blank", "blank_values"))
        .withColumn("detail", detail)
        .select(
            *VERSION, "col_seq", "column_name", "statistical_scale", "data_type", "completeness_percent",
            "missing_count", "mismatched_count", "blank_value_count", "rule_seq", "issue", "detail", "action",
        )
    )


def governance(sc: DataFrame) -> DataFrame:
    """Identifier, privacy and leakage risks."""
    return _rules(
        sc, "risk_type", ("g_identifier", "IDENTIFIER"), ("g_privacy", "PRIVACY"), ("prob_like", "LEAKAGE")
    ).select(
        *VERSION, "col_seq", "column_name", "statistical_scale", "data_type", "cardinality_count", "rule_seq",
        "risk_type", "action",
    )


def readiness(sc: DataFrame) -> DataFrame:
    """Drop, caution or ready per column."""
    why = F.concat_ws(
        " and ",
        F.when(F.col("governed"), "governance or leakage risk"),
        F.when(F.col("warned"), "data quality warning"),
    )
    reason = F.when(F.col("status") == "caution", F.concat(F.lit("Review: "), why)).otherwise(
        text.lookup(F.col("status"), text.READINESS_REASONS)
    )
    return sc.select(
        *VERSION, "ordinal_position", "column_name", "data_type", "statistical_scale", "completeness_percent",
        "cardinality_count", "status", "governed", "warned", reason.alias("reason"),
    )


def pick_target(profiles: DataFrame, target_col: str | None = None) -> DataFrame:
    """The label column of each version: the given name, else the first of the fixed priority."""
    rank = target_rank(F.col("column_name"))
    if target_col is not None:
        rank = F.when(F.col("column_name") == target_col, F.lit(-1)).otherwise(rank)
    first = Window.partitionBy(*VERSION).orderBy("pick", "col_seq")
    return (
        profiles.withColumn("pick", rank)
        .where("pick is not null")
        .withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
        .drop("pick", "rn")
    )


def target_analysis(sc: DataFrame, cfg: Thresholds = Thresholds(), target_col: str | None = None) -> DataFrame:
    """Event rate and class balance of the label column."""
    usable = (F.col("data_type") == "num") & F.col("mean").isNotNull()
    ratio = F.when(F.col("m") > 0, F.round(F.try_divide(1 - F.col("m"), F.col("m")), 2))
    balance = (
        F.when(F.col("imbalance_ratio").isNull(), "unknown")
        .when(F.col("imbalance_ratio") < cfg.imbalance_notable, "balanced")
        .when(F.col("imbalance_ratio") < cfg.imbalance_severe, "moderate")
        .otherwise("severe")
    )
    ok = lambda c: F.when(F.col("usable"), c)
    return (
        pick_target(sc, target_col)
        .withColumn("usable", usable)
        .withColumn("m", ok(F.col("mean")))
        .withColumn("imbalance_ratio", ratio)
        .withColumn("balance_label", ok(balance))
        .select(
            *VERSION,
            "column_name",
            "cardinality_count",
            "statistical_scale",
            ok(F.round(F.col("m") * 100, 2)).alias("event_rate"),
            ok(F.round((1 - F.col("m")) * 100, 2)).alias("non_event_rate"),
            "imbalance_ratio",
            "balance_label",
            ok(F.round(safe(F.col("skewness")), 4)).alias("skewness"),
            F.col("completeness_percent").alias("completeness"),
            "row_count",
            "blocked",
            F.when(~F.col("usable"), "no statistics for the target column").alias("error"),
            text.lookup_list(F.col("balance_label"), text.TARGET_ADVICE).alias("recommendations"),
        )
    )


def distribution_health(sc: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """Shape of numeric columns that are in play."""
    s = F.col("skewness")
    label = (
        F.when(F.abs(s) < cfg.skew_symmetric, "symmetric")
        .when(s > 1, "right-skewed")
        .when(s < -1, "left-skewed")
        .otherwise("mild skew")
    )
    lower, upper = F.col("median") - F.col("q25"), F.col("q75") - F.col("median")
    shorter = F.least(lower, upper)
    longest = F.greatest(lower, upper)
    symmetric = F.when(
        shorter.isNotNull() & lower.isNotNull() & upper.isNotNull(),
        longest / F.when(shorter > 0, shorter).otherwise(0.0001) < 1.5,
    )
    bounded = F.coalesce(
        (F.col("min_val") >= 0) & (F.col("max_val") <= 1) & (F.col("cardinality_count") >= cfg.leakage_cardinality),
        F.lit(False),
    )
    return sc.where("has_shape").select(
        *VERSION,
        "col_seq",
        "column_name",
        "statistical_scale",
        F.round(safe(F.col("mean")), 4).alias("mean"),
        F.round(safe(F.col("std")), 4).alias("std"),
        "min_val",
        "max_val",
        F.round(s, 4).alias("skewness"),
        label.alias("skew_label"),
        "has_outliers",
        "n_outliers",
        symmetric.alias("iqr_symmetric"),
        bounded.alias("bounded_unit"),
        "q25",
        "q50",
        "q75",
    )


def health_scores(sc: DataFrame) -> DataFrame:
    """Column health score, its parts and the top issue."""
    return sc.select(
        *VERSION, "col_seq", "column_name", "score", "health_label", *[f"p_{d}" for d in DIMENSIONS], "worst_dim",
        top_issue().alias("top_issue"),
    )


def top_issue() -> Column:
    """S8t: wording for the lowest part of the score."""
    bad = (F.col("mismatched_count") + F.col("blank_value_count")) / F.greatest(F.col("row_count"), F.lit(1))
    d = F.col("worst_dim")
    return (
        F.when(d == "completeness", F.concat(num(100 - F.col("completeness_percent"), 1), F.lit("% of rows missing")))
        .when((d == "variance") & _in_scales(["unary"]), "constant column")
        .when((d == "variance") & _in_scales(["id"]), "identifier without signal")
        .when(d == "variance", "very low variance")
        .when(d == "mismatch", F.concat(num(bad * 100, 1), F.lit("% of rows badly formatted or blank")))
        .when((d == "governance") & F.col("prob_like"), "resembles a model score")
        .when((d == "governance") & F.col("has_unique_field"), "unique identifier")
        .when(d == "governance", "privacy sensitive")
        .when(F.abs(safe(F.col("skewness"))) > 1, F.concat(F.lit("high skewness "), num(F.col("skewness"), 2)))
        .otherwise(F.concat(F.lit("outliers: "), F.col("n_outliers")))
    )


def action_list(sc: DataFrame) -> DataFrame:
    """Ranked fixes per version. Sources keep their order on equal priority."""
    # blockers 0, governance 1, warnings 2, low scores 3
    sources = [
        ("b_missing", 0, "high_missing"), ("b_zero", 0, "zero_variance"), ("b_mismatch", 0, "severe_mismatch"),
        ("g_identifier", 1, "IDENTIFIER"), ("g_privacy", 1, "PRIVACY"), ("prob_like", 1, "LEAKAGE"),
        ("w_partial", 2, "partial_missing"), ("w_format", 2, "format_mismatch"),
    ]
    entry = lambda source, seq, rule: F.struct(
        F.lit(source).alias("source"), F.lit(seq).alias("seq"), F.lit(rule).alias("rule")
    )
    fired = keep_when(*[(F.col(flag), entry(source, i, rule)) for i, (flag, source, rule) in enumerate(sources)])
    weak = ~F.col("is_target") & (F.col("score") < 55) & (F.col("worst_dim") == "distribution") & (F.col("data_type") == "num")
    shape_fix = keep_when(
        (weak & (F.abs(safe(F.col("skewness"))) > 1), entry(3, 8, "transform")),
        (weak & ~(F.abs(safe(F.col("skewness"))) > 1) & (F.col("n_outliers") > 0), entry(3, 9, "winsorise")),
    )
    tier = {r: vocab.SEVERITY_TIER[s] * i for r, (s, i, _) in vocab.ACTION_RULES.items()}
    rule = F.col("rule")
    pick = lambda values: F.coalesce(*[F.when(rule == k, F.lit(v)) for k, v in values.items()])
    order = Window.partitionBy(*VERSION).orderBy(F.desc("priority_score"), "source", "col_seq", "seq")
    return (
        sc.withColumn("fired", fired)
        .select(
            *VERSION,
            "col_seq",
            "column_name",
            F.inline(F.when(F.size("fired") > 0, F.col("fired")).otherwise(shape_fix)),
        )
        .withColumns(
            {
                "severity": pick({k: v[0] for k, v in vocab.ACTION_RULES.items()}),
                "impact": pick({k: v[1] for k, v in vocab.ACTION_RULES.items()}),
                "effort": pick({k: v[2] for k, v in vocab.ACTION_RULES.items()}),
                "priority_score": pick(tier),
                "action": text.lookup(rule, text.RULE_ACTIONS),
                "why": text.lookup(rule, text.RULE_REASONS),
            }
        )
        .withColumn("action_rank", F.row_number().over(order))
        .drop("seq", "col_seq")
    )


def dataset_readiness(sc: DataFrame) -> DataFrame:
    """Weighted mean of column scores per version; dropped columns count as zero."""
    weight = F.when(F.col("is_target"), 0.0).when(F.col("status") == "caution", 0.5).otherwise(1.0)
    value = F.when(F.col("status") == "drop", 0.0).otherwise(F.col("score"))
    feature = lambda s: F.count_if(~F.col("is_target") & (F.col("status") == s))
    return (
        sc.withColumn("w", weight)
        .groupBy(*VERSION)
        .agg(
            F.max("abt_name").alias("abt_name"),
            F.sum("w").alias("total_w"),
            # tenths are summed as integers so the order of addition does not matter
            F.sum(F.round(value * F.col("w") * 20).cast("bigint")).alias("twentieths"),
            F.count(F.lit(1)).alias("total_cols"),
            feature("drop").alias("blocked_cols"),
            feature("caution").alias("caution_cols"),
            feature("ready").alias("ready_cols"),
            F.count_if("is_target").alias("target_cols"),
        )
        .withColumn(
            "score",
            F.when(F.col("total_w") > 0, F.round(F.try_divide(F.col("twentieths") / 20.0, F.col("total_w")), 1)).otherwise(0.0),
        )
        .withColumn(
            "readiness_label",
            F.when(F.col("score") >= 80, "ready")
            .when(F.col("score") >= 65, "mostly_ready")
            .when(F.col("score") >= 45, "needs_work")
            .otherwise("not_ready"),
        )
        .withColumn("feature_cols", F.col("blocked_cols") + F.col("caution_cols") + F.col("ready_cols"))
        .drop("total_w", "twentieths")
    )


def status_counts(sc: DataFrame) -> DataFrame:
    """Columns per readiness status, with health sorted worst first available from S8."""
    return sc.groupBy(*VERSION, "status").agg(
        F.count(F.lit(1)).alias("columns"), F.min("score").alias("worst_score")
    )


def by_status(sc: DataFrame, status: str) -> DataFrame:
    return readiness(sc).where(F.col("status") == status)


def worst_first(sc: DataFrame) -> DataFrame:
    order = Window.partitionBy(*VERSION).orderBy("score", "col_seq")
    return health_scores(sc).withColumn("health_rank", F.row_number().over(order))


def analysis_export(sc: DataFrame) -> DataFrame:
    """K1: the flat analysis sheet, one row per column."""
    risks = keep_when(
        (F.col("g_identifier"), F.lit("IDENTIFIER")),
        (F.col("g_privacy"), F.lit("PRIVACY")),
        (F.col("prob_like"), F.lit("LEAKAGE")),
    )
    return sc.select(
        F.col("abt_name").alias("table_name"),
        "version", "snapshot_date", "row_count", "column_name", "data_type", "statistical_scale",
        "ordinal_position",
        F.col("completeness_percent").alias("completeness_pct"),
        "missing_count",
        F.col("cardinality_count").alias("cardinality"),
        F.col("uniqueness_percent").alias("uniqueness_pct"),
        "mean", "median", "std",
        F.col("min_val").alias("min"),
        F.col("max_val").alias("max"),
        "skewness", "kurtosis", "q25", "q50", "q75", "has_outliers", "n_outliers", "blank_value_count",
        "mismatched_count",
        F.coalesce("information_privacy", F.lit("")).alias("information_privacy"),
        "has_unique_field",
        F.col("status").alias("readiness_status"),
        F.col("score").alias("health_score"),
        "health_label",
        top_issue().alias("health_top_issue"),
        F.col("blocked").alias("is_blocker"),
        F.col("governed").alias("is_governance_risk"),
        F.concat_ws(",", risks).alias("governance_risk_types"),
    )


def catalog_rollup(sc: DataFrame) -> DataFrame:
    """The catalog at three levels in one pass: every version, every table, all tables (``level`` 0, 1, 3).

    ``level`` is the grouping id, so that a null version of a table is told apart from the table's own row.
    """
    status = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return (
        sc.select("table_name", "version", "row_count", "missing_count", "score", "status")
        .rollup("table_name", "version")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("columns"),
            F.sum("row_count").alias("cells"),
            F.sum("missing_count").alias("missing_cells"),
            F.round(100.0 * (1 - F.sum("missing_count") / F.sum("row_count")), 4).alias("completeness_percent"),
            F.min("score").alias("worst_score"),
            *[status(s) for s in ("ready", "caution", "drop")],
        )
    )
