"""Comparison of N versions, for all tables of a catalog at once.

``g`` is the column × version grid, ``pairs`` the consecutive pairs with their metrics. Every
operator groups by (table, column) or by table; nothing is collected but names of one table's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve import vocab
from varve.config import Thresholds
from varve.functions import text
from varve.functions.scalars import is_target, rank_in, safe, severity_rank, slope, status_order, target_rank
from varve.operators.drift import worst_psi_label
from varve.operators.pairs import COLUMN, versions

TABLE = "table_name"
PAIR = [TABLE, "pair_idx", "from_ver", "to_ver"]


def names_where(cond: Column) -> Column:
    """Sorted column names of a table that satisfy a condition."""
    return F.array_sort(F.collect_list(F.when(cond, F.col("column_name"))))


def first_present(value: Column, present: Column) -> Column:
    return F.min_by(value, F.when(present, F.col("ver_idx")))


def last_present(value: Column, present: Column) -> Column:
    return F.max_by(value, F.when(present, F.col("ver_idx")))


def _in_both() -> Column:
    return F.col("a").isNotNull() & F.col("b").isNotNull()


# ── C1, C2 schema ───────────────────────────────────────────────────────────────────────────────


def version_summary(profiles: DataFrame) -> DataFrame:
    """C1 versions."""
    return versions(profiles)


def pair_summary(pairs: DataFrame) -> DataFrame:
    """C1 pairs: row delta, added and dropped columns, readiness moves."""
    move = status_order(F.col("b.status")) - status_order(F.col("a.status"))
    both = _in_both()
    return pairs.groupBy(*PAIR, "last_pair", "from_rows", "to_rows").agg(
        (F.col("to_rows") - F.col("from_rows")).alias("row_delta"),
        names_where(F.col("a").isNull() & F.col("b").isNotNull()).alias("added"),
        names_where(F.col("a").isNotNull() & F.col("b").isNull()).alias("dropped"),
        names_where(both & (move > 0)).alias("worsened"),
        names_where(both & (move < 0)).alias("improved"),
        F.count_if(both & (move == 0)).alias("stable_count"),
    )


def schema_changes(pairs: DataFrame) -> DataFrame:
    """Added, dropped and type-changed columns per pair."""
    kind = lambda s: F.concat_ws(" / ", F.col(f"{s}.cas_data_type"), F.col(f"{s}.statistical_scale"))
    change = (
        F.when(F.col("a").isNull() & F.col("b").isNotNull(), "added")
        .when(F.col("a").isNotNull() & F.col("b").isNull(), "dropped")
        .when(_in_both() & (kind("a") != kind("b")), "type_changed")
    )
    return (
        pairs.withColumn("change", change)
        .where("change is not null")
        .select(
            *PAIR,
            "last_pair",
            "column_name",
            "change",
            F.when(F.col("a").isNotNull(), kind("a")).alias("from_type"),
            F.when(F.col("b").isNotNull(), kind("b")).alias("to_type"),
            F.coalesce("b.completeness_percent", "a.completeness_percent").alias("completeness"),
        )
    )


# ── C3 completeness ─────────────────────────────────────────────────────────────────────────────


def completeness_changes(pairs: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """C3 change rows: moves of at least the configured percentage points."""
    delta = F.col("b.completeness_percent") - F.col("a.completeness_percent")
    return pairs.where(F.abs(delta) >= cfg.completeness_delta_min).select(
        *PAIR,
        "column_name",
        F.round(delta, 1).alias("delta"),
        F.when(delta > 0, "improved").otherwise("regressed").alias("direction"),
    )


def missing_pattern(first: Column, last: Column, lowest: Column, highest: Column) -> Column:
    """C3p: first rule that fits the series of completeness values."""
    return (
        F.when(first.isNull(), "absent")
        .when(lowest == 100, "complete")
        .when(highest < 50, "sparse")
        .when((first == 100) & (last < 100), "newly_missing")
        .when((first < 100) & (last > first + 5), "recovering")
        .when(last < first - 5, "growing_missing")
        .when((lowest < 100) & (F.abs(last - first) <= 5), "stable_missing")
        .otherwise("fluctuating")
    )


def completeness_series(g: DataFrame) -> DataFrame:
    """C3 rows: net change and missing pattern per column, first version with gaps included."""
    comp, here = F.col("p.completeness_percent"), F.col("present")
    return (
        g.groupBy(*COLUMN, "first_version", "first_seq", "n_versions")
        .agg(
            first_present(comp, here).alias("first_comp"),
            last_present(comp, here).alias("last_comp"),
            F.min(comp).alias("low"),
            F.max(comp).alias("high"),
            F.max(F.when(F.col("ver_idx") == 0, comp)).alias("at_start"),
            F.max(F.when(F.col("ver_idx") == F.col("n_versions") - 1, comp)).alias("at_end"),
            F.min_by("ver_name", F.when(comp < 100, F.col("ver_idx"))).alias("first_gap_version"),
        )
        .withColumn("net_delta", F.round(F.col("at_end") - F.col("at_start"), 1))
        .withColumn(
            "missing_pattern",
            missing_pattern(F.col("first_comp"), F.col("last_comp"), F.col("low"), F.col("high")),
        )
        .drop("low", "high", "at_start", "at_end")
    )


# ── C4 distribution ─────────────────────────────────────────────────────────────────────────────


def drift_scope(df: DataFrame) -> DataFrame:
    """Columns that were numeric measures (no label) in the first version."""
    return df.where(
        (F.col("base.data_type") == "num")
        & ~F.col("base.statistical_scale").isin(*vocab.NON_DISTRIBUTION_SCALES)
        & ~is_target(F.col("column_name"))
    )


def drift_flags(pairs: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """C4 flags: mean move in base deviations, skew flips, new outliers."""
    A, B = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    score = F.abs((B("mean") - A("mean")) / F.greatest(safe(A("std"), 1.0), F.lit(1e-9)))
    flip = F.coalesce(F.abs(B("skewness") - A("skewness")) > 0.5, F.lit(False))
    fresh = F.coalesce(B("has_outliers") & ~A("has_outliers"), F.lit(False))
    return (
        drift_scope(pairs)
        .where((A("data_type") == "num") & (B("data_type") == "num") & A("mean").isNotNull() & B("mean").isNotNull())
        .withColumns({"raw_score": score, "skew_flip": flip, "outlier_new": fresh})
        .select(
            *PAIR,
            "last_pair",
            "column_name",
            F.round(B("mean") - A("mean"), 4).alias("mean_delta"),
            F.round("raw_score", 3).alias("drift_score"),
            "skew_flip",
            "outlier_new",
            F.when((F.col("raw_score") > cfg.drift_severe) | F.col("skew_flip"), "critical")
            .when((F.col("raw_score") > cfg.drift_notable) | F.col("outlier_new"), "notable")
            .otherwise("stable")
            .alias("severity"),
        )
    )


def distribution_drift(g: DataFrame, flags: DataFrame) -> DataFrame:
    """C4: worst severity per column, with the last flag kept for later rules."""
    scope = drift_scope(g).select(*COLUMN, F.col("base.statistical_scale").alias("scale")).distinct()
    worst = flags.groupBy(*COLUMN).agg(
        F.max(severity_rank(F.col("severity"))).alias("worst"),
        F.max_by("mean_delta", "pair_idx").alias("last_mean_delta"),
        F.max_by("drift_score", "pair_idx").alias("last_drift_score"),
        F.max_by("severity", "pair_idx").alias("last_severity"),
        F.count(F.lit(1)).alias("flag_count"),
    )
    return (
        scope.join(worst, COLUMN, "left")
        .withColumn(
            "overall_severity", F.when(F.col("worst") == 2, "critical").when(F.col("worst") == 1, "notable").otherwise("stable")
        )
        .withColumn("flag_count", F.coalesce("flag_count", F.lit(0)))
        .drop("worst")
    )


def version_stats(g: DataFrame) -> DataFrame:
    """C4s: series of statistics behind the drift flags."""
    stat = lambda f: F.when(F.col("p.data_type") == "num", F.col(f"p.{f}"))
    return drift_scope(g).select(
        *COLUMN,
        "ver_idx",
        "ver_name",
        *[stat(f).alias(f) for f in ["mean", "std", "skewness", "has_outliers", "n_outliers", "min_val", "max_val"]],
    )


# ── C5 target ───────────────────────────────────────────────────────────────────────────────────


def target_columns(g: DataFrame) -> DataFrame:
    """The label column of each table, chosen from its first version."""
    order = Window.partitionBy(TABLE).orderBy("rank")
    return (
        g.where((F.col("ver_idx") == 0) & F.col("present"))
        .withColumn("rank", target_rank(F.col("column_name")))
        .where("rank is not null")
        .withColumn("rn", F.row_number().over(order))
        .where("rn = 1")
        .select(*COLUMN)
    )


def target_rates(g: DataFrame) -> DataFrame:
    """C5 rates per version."""
    m = F.col("p.mean")
    return g.join(target_columns(g), COLUMN, "left_semi").select(
        *COLUMN,
        "ver_idx",
        "ver_name",
        F.round(m * 100, 2).alias("event_rate"),
        F.when(m > 0, F.round(F.try_divide(1 - m, m), 2)).alias("imbalance_ratio"),
        F.when(m.isNotNull(), F.round(safe(F.col("p.skewness")), 4)).alias("skewness"),
    )


def target_drift(rates: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """C5 pairs: change of the event rate."""
    by = Window.partitionBy(*COLUMN).orderBy("ver_idx")
    delta = (F.col("next_rate") - F.col("event_rate")) / 100
    return (
        rates.withColumns({"next_rate": F.lead("event_rate").over(by), "to_ver": F.lead("ver_name").over(by)})
        .withColumn("delta", delta)
        .where("delta is not null")
        .select(
            *COLUMN,
            F.col("ver_idx").alias("pair_idx"),
            F.col("ver_name").alias("from_ver"),
            "to_ver",
            F.round(F.col("delta") * 100, 2).alias("delta_pp"),
            F.round(F.abs("delta") * 100, 2).alias("abs_delta_pp"),
            F.when(F.abs("delta") >= cfg.target_drift_critical, "critical")
            .when(F.abs("delta") >= cfg.target_drift_notable, "notable")
            .otherwise("stable")
            .alias("severity"),
        )
        .withColumn("back_test_required", F.col("severity") != "stable")
    )


# ── C6, C7 quality and readiness ────────────────────────────────────────────────────────────────


def _trend(first: Column, last: Column, n: Column, up: str, down: str) -> Column:
    return F.when(n < 2, "unknown").when(last > first, up).when(last < first, down).otherwise("stable")


def quality_regression(g: DataFrame) -> DataFrame:
    """Columns with format or blank problems in any version and where they are heading."""
    here = F.col("present")
    aggs = []
    for name, field in [("mismatch", "mismatched_count"), ("blank", "blank_value_count")]:
        c = F.col(f"p.{field}")
        aggs += [
            first_present(c, here).alias(f"{name}_first"),
            last_present(c, here).alias(f"{name}_last"),
            F.max(c).alias(f"{name}_max"),
        ]
    trend = lambda n: _trend(F.col(f"{n}_first"), F.col(f"{n}_last"), F.col("n_present"), "regressing", "improving")
    return (
        g.groupBy(*COLUMN)
        .agg(F.count_if("present").alias("n_present"), *aggs)
        .where("mismatch_max > 0 or blank_max > 0")
        .withColumns({"mismatch_trend": trend("mismatch"), "blank_trend": trend("blank")})
        .drop("n_present")
    )


def readiness_change(g: DataFrame) -> DataFrame:
    """Readiness in the first and the last version; worsened and dropped columns first."""
    order = Window.partitionBy(TABLE).orderBy(F.desc("highlight"), "column_name")
    at = lambda i: F.coalesce(F.max(F.when(F.col("ver_idx") == i, F.col("p.status"))), F.lit("absent"))
    first, last = F.col("first_status"), F.col("last_status")
    return (
        g.groupBy(*COLUMN, "n_versions")
        .agg(at(F.lit(0)).alias("first_status"), at(F.col("n_versions") - 1).alias("last_status"))
        .withColumn(
            "change_type",
            F.when(first == "absent", "new")
            .when(last == "absent", "dropped")
            .when(status_order(last) > status_order(first), "worsened")
            .when(status_order(last) < status_order(first), "improved")
            .otherwise("stable"),
        )
        .withColumn("highlight", F.col("change_type").isin("worsened", "dropped"))
        .withColumn("change_rank", F.row_number().over(order))
        .drop("n_versions")
    )


def version_values(g: DataFrame, *fields: str) -> DataFrame:
    """The series behind C3, C6, C7, C9 and C10: facts of each column at each version, NULL where it is absent."""
    return g.select(*COLUMN, "ver_idx", "present", *[F.col(f"p.{f}").alias(f) for f in fields])


# ── C8 stability index ──────────────────────────────────────────────────────────────────────────


def psi_worst(metrics: DataFrame) -> DataFrame:
    """C8 columns: worst label, worst and latest index of each column."""
    scored_pair = F.when(F.col("psi_applicable"), F.col("pair_idx"))
    return (
        metrics.groupBy(*COLUMN, "first_version", "first_seq")
        .agg(
            worst_psi_label().alias("worst_label"),
            F.max("psi").alias("max_psi"),
            F.max_by("psi", scored_pair).alias("last_psi"),
        )
        .withColumn("label_order", rank_in(F.col("worst_label"), vocab.PSI_LABEL_ORDER, 3))
    )


def psi_summary(worst: DataFrame) -> DataFrame:
    """C8 summary: counts per label and the names of shifted columns in first-seen order."""
    label = lambda l: F.count_if(F.col("worst_label") == l)
    shifted = F.collect_list(
        F.when(F.col("worst_label") == "shift", F.struct("first_version", "first_seq", "column_name"))
    )
    return worst.groupBy(TABLE).agg(
        label("stable").alias("stable_count"),
        label("monitor").alias("monitor_count"),
        label("shift").alias("shift_count"),
        F.array_sort(shifted).getField("column_name").alias("critical_columns"),
    )


def psi_heatmap(metrics: DataFrame) -> DataFrame:
    """C8h: one cell per column and pair, over all pairs; a chart pivots it by ``pair_idx``."""
    return metrics.select(*COLUMN, "pair_idx", "psi")


# ── C9 health ───────────────────────────────────────────────────────────────────────────────────


def health_trend(g: DataFrame) -> DataFrame:
    """C9 columns: where each health score is heading; trouble first."""
    s, here = F.col("p.score"), F.col("present")
    order = Window.partitionBy(TABLE).orderBy(
        F.desc("highlight"), F.when(F.col("worst_score") == 0, 100.0).otherwise(F.col("worst_score")), "first_version", "first_seq"
    )
    return (
        g.groupBy(*COLUMN, "first_version", "first_seq")
        .agg(
            F.count(s).alias("n"),
            first_present(s, here).alias("first_score"),
            last_present(s, here).alias("last_score"),
            F.min(s).alias("worst_score"),
        )
        .withColumn("trend", _trend(F.col("first_score"), F.col("last_score"), F.col("n"), "improving", "declining"))
        .withColumn("delta", F.when(F.col("n") >= 2, F.round(F.col("last_score") - F.col("first_score"), 1)))
        .withColumn("highlight", (F.col("worst_score") < 40) | (F.col("trend") == "declining"))
        .withColumn("health_rank", F.row_number().over(order))
        .drop("n", "first_version", "first_seq")
    )


def dataset_trend(s0: DataFrame) -> DataFrame:
    """C9 dataset: first and last readiness score and the slope over versions."""
    idx = F.row_number().over(Window.partitionBy(TABLE).orderBy("version")) - 1
    y, x = F.col("score"), F.col("x")
    n = F.count(F.lit(1))
    fitted = F.round(slope(n.cast("double"), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x)), 3)
    s = F.col("trend_slope")
    return (
        s0.withColumn("x", idx.cast("double"))
        .groupBy(TABLE)
        .agg(
            n.alias("n_versions"),
            F.min_by("score", "version").alias("first_score"),
            F.max_by("score", "version").alias("last_score"),
            F.max_by("readiness_label", "version").alias("last_label"),
            F.when(n >= 3, fitted).alias("trend_slope"),
        )
        .withColumn(
            "trend_direction",
            F.when(s.isNull(), "insufficient_data")
            .when(s > 1.0, "strongly_improving")
            .when(s > 0.2, "improving")
            .when(s < -1.0, "strongly_declining")
            .when(s < -0.2, "declining")
            .otherwise("stable"),
        )
        .withColumn("score_delta", F.when(F.col("n_versions") >= 2, F.round(F.col("last_score") - F.col("first_score"), 1)))
    )


# ── C10 cardinality ─────────────────────────────────────────────────────────────────────────────


def cardinality_drift(pairs: DataFrame) -> DataFrame:
    """C10 events: growth of distinct values, or their loss."""
    c1, c2 = F.col("a.cardinality_count"), F.col("b.cardinality_count")
    ratio = F.when((c1 > 0) & (c2 > 0), c2 / c1)
    severity = (
        F.when(ratio >= 1.5, "critical")
        .when(ratio >= 1.2, "notable")
        .when((c1 > 0) & (F.coalesce(c2, F.lit(0)) == 0), "dropped")
    )
    return pairs.withColumn("severity", severity).where("severity is not null").select(
        *PAIR,
        "first_version",
        "first_seq",
        "column_name",
        F.coalesce("base.statistical_scale", F.lit("nominal")).alias("scale"),
        c1.alias("from_card"),
        F.when(c2 > 0, c2).alias("to_card"),
        F.round(ratio, 2).alias("ratio"),
        "severity",
    )


# ── C0 verdict ──────────────────────────────────────────────────────────────────────────────────


def verdict(
    target_moves: DataFrame, psi_counts: DataFrame, pair_moves: DataFrame, trend: DataFrame
) -> DataFrame:
    """One verdict per table from label drift, feature drift, readiness moves and dataset score."""
    moves = target_moves.where("back_test_required").groupBy(TABLE).agg(F.count(F.lit(1)).alias("target_moves"))
    degraded = pair_moves.where(F.size("worsened") >= 2).groupBy(TABLE).agg(F.count(F.lit(1)).alias("degraded_pairs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    df = (
        trend.join(moves, TABLE, "left")
        .join(psi_counts.select(TABLE, "shift_count", "critical_columns"), TABLE, "left")
        .join(degraded, TABLE, "left")
        .withColumns({c: zero(F.col(c)) for c in ["target_moves", "shift_count", "degraded_pairs"]})
    )
    many = F.col("n_versions") >= 2
    block = many & (F.col("last_score") < 40)
    fell_far = many & ~block & (F.col("last_score") < F.col("first_score") - 15)
    fell = many & ~block & ~fell_far & (F.col("last_score") < F.col("first_score") - 8)
    return (
        df.withColumns({"block": block, "fell_far": fell_far})
        .withColumn(
            "back_test_required",
            (F.col("target_moves") > 0) | (F.col("shift_count") > 0) | (F.col("degraded_pairs") > 0) | F.col("fell_far"),
        )
        .withColumn(
            "issue_count",
            F.col("target_moves")
            + (F.col("shift_count") > 0).cast("int")
            + F.col("degraded_pairs")
            + (F.col("block") | F.col("fell_far") | (fell & ~F.col("back_test_required"))).cast("int"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("block"), "BLOCK")
            .when(F.col("back_test_required"), "BACK_TEST_REQUIRED")
            .when(F.col("issue_count") > 0, "MONITOR")
            .otherwise("CLEAR"),
        )
        .withColumn("color", text.lookup(F.col("verdict"), vocab.VERDICT_COLOURS))
        .withColumn("message", text.lookup(F.col("verdict"), text.VERDICT_MESSAGES))
        .select(
            TABLE, "verdict", "color", "message", "back_test_required", "issue_count", "target_moves", "shift_count",
            F.coalesce("critical_columns", F.array().cast("array<string>")).alias("shift_columns"),
            "degraded_pairs", "first_score", "last_score",
        )
    )


def verdict_issues(c0: DataFrame, target_moves: DataFrame, pair_moves: DataFrame) -> DataFrame:
    """C0 issues as rows: what led to the verdict."""
    v = c0.select(TABLE, "verdict")
    pick = lambda df, issue, measure, from_ver, to_ver: df.select(
        TABLE, "verdict", issue.alias("issue"), measure.cast("double").alias("measure"), from_ver.alias("from_ver"), to_ver.alias("to_ver")
    )
    none = F.lit(None).cast("string")
    last, first = F.col("last_score"), F.col("first_score")
    decline = (
        F.when(F.col("verdict") == "BLOCK", "dataset_not_ready")
        .when(last < first - 15, "dataset_declined")
        .when((last < first - 8) & ~F.col("back_test_required"), "dataset_slipping")
    )
    pair_ends = (F.col("from_ver"), F.col("to_ver"))
    return (
        pick(
            target_moves.where("back_test_required").join(v, TABLE),
            F.concat(F.lit("target_"), F.col("severity")), F.col("delta_pp"), *pair_ends,
        )
        .unionByName(pick(c0.where("shift_count > 0"), F.lit("shifted_features"), F.col("shift_count"), none, none))
        .unionByName(
            pick(pair_moves.where(F.size("worsened") >= 2).join(v, TABLE), F.lit("readiness_degraded"), F.size("worsened"), *pair_ends)
        )
        .unionByName(pick(c0.where(decline.isNotNull()), decline, last, none, none))
    )


# ── C12, C13 overview feeds ─────────────────────────────────────────────────────────────────────


def overview_matrix(
    health: DataFrame, series: DataFrame, readiness: DataFrame, worst: DataFrame, drift: DataFrame, cards: DataFrame
) -> DataFrame:
    """One row per column over all comparison sections; most severe first."""
    cardinality = cards.select(*COLUMN).distinct().withColumn("cardinality_event", F.lit(True))
    df = (
        worst.select(*COLUMN, "worst_label", "label_order")
        .join(health.select(*COLUMN, "last_score"), COLUMN, "left")
        .join(series.select(*COLUMN, "last_comp", "missing_pattern"), COLUMN, "left")
        .join(readiness.select(*COLUMN, "last_status", "change_type"), COLUMN, "left")
        .join(drift.select(*COLUMN, "overall_severity"), COLUMN, "left")
        .join(cardinality, COLUMN, "left")
        .withColumn("cardinality_event", F.coalesce("cardinality_event", F.lit(False)))
    )
    order = Window.partitionBy(TABLE).orderBy(
        "label_order", F.desc(severity_rank(F.col("overall_severity"))), "column_name"
    )
    return df.withColumn("overview_rank", F.row_number().over(order)).drop("label_order")


def find_columns(matrix: DataFrame, part: str) -> DataFrame:
    return matrix.where(F.lower("column_name").contains(part.lower()))


def quantile_trend(g: DataFrame) -> DataFrame:
    """C13 trend: the five-number summary and mean of each version in long form."""
    stats = {"max": "max_val", "q3": "q75", "median": "q50", "q1": "q25", "min": "min_val", "mean": "mean"}
    wide = g.where("p.data_type = 'num'").select(*COLUMN, "ver_idx", *[F.col(f"p.{v}").alias(k) for k, v in stats.items()])
    return wide.unpivot([*COLUMN, "ver_idx"], list(stats), "stat", "value").where("value is not null")


def ridge_density(g: DataFrame) -> DataFrame:
    """C13 ridges: density of each inter-quartile bin, a quarter of the mass over its width."""
    pts = [F.col(f"p.{f}") for f in ("min_val", "q25", "q50", "q75", "max_val")]
    bins = [
        F.struct(F.lit(i).alias("bin"), lo.alias("lo"), hi.alias("hi"), (0.25 / F.greatest(hi - lo, F.lit(1e-9))).alias("density"))
        for i, (lo, hi) in enumerate(zip(pts, pts[1:]))
    ]
    known = F.lit(True)
    for p in pts:
        known = known & p.isNotNull()
    return g.where(known).select(*COLUMN, "ver_idx", F.inline(F.array(*bins)))
