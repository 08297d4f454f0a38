"""Interpretation of a comparison: per table, what moved, why, and what the model needs.

Inputs are the comparison sections; every operator is one aggregation by table or a chain of
equi-joins on (table, column). ``_refined`` variants add the later tiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve import vocab
from varve.functions import text
from varve.functions.scalars import keep_when, safe
from varve.operators.compare import TABLE
from varve.operators.drift import suite_scope
from varve.operators.pairs import COLUMN


def _zero(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n), F.lit(0)) for n in names}


def _list(cond: Column) -> Column:
    """Names in first-seen order of the columns that satisfy a condition."""
    return F.array_sort(
        F.collect_list(F.when(cond, F.struct("first_version", "first_seq", "column_name")))
    ).getField("column_name")


# ── I4 population ───────────────────────────────────────────────────────────────────────────────


def population_shift(tables: DataFrame, c1: DataFrame, c4: DataFrame, places: DataFrame, d13: DataFrame) -> DataFrame:
    """I4: how broad the drift is, whether it is coordinated and how far from the first version."""
    drifted = F.col("overall_severity").isin("critical", "notable")
    moved = F.coalesce(F.col("last_mean_delta"), F.lit(0.0))
    per_table = (
        c4.join(places, COLUMN)
        .groupBy(TABLE)
        .agg(
            F.count(F.lit(1)).alias("total_features"),
            F.count_if(drifted).alias("drifted_count"),
            F.count_if(drifted & (moved > 0)).alias("up"),
            F.count_if(drifted & (moved < 0)).alias("down"),
            _list(drifted).alias("drifted_features"),
        )
    )
    rows = c1.where("last_pair").select(
        TABLE,
        F.when(F.col("from_rows") > 0, F.round(F.try_divide(F.col("row_delta"), F.col("from_rows")) * 100, 1)).alias("row_delta_pct"),
    )
    far = d13.groupBy(TABLE).agg(
        F.avg((F.col("worst_label") == "shift").cast("double")).alias("shift_share"),
        F.avg(F.col("worst_label").isin("shift", "monitor").cast("double")).alias("moved_share"),
    )
    moves = F.col("up") + F.col("down")
    share = F.col("drifted_count") / F.greatest(F.col("total_features"), F.lit(1))
    none = F.col("total_features") == 0
    big_row_move = F.coalesce(F.abs("row_delta_pct") > 20, F.lit(False))
    return (
        tables.select(TABLE)
        .join(per_table, TABLE, "left")
        .join(rows, TABLE, "left")
        .join(far, TABLE, "left")
        .withColumns(_zero("total_features", "drifted_count", "up", "down"))
        .withColumns(
            {
                "coordinated": (F.col("drifted_count") >= 3)
                & (moves >= 3)
                & (F.greatest("up", "down") / F.greatest(moves, F.lit(1)) > 0.7),
                "v1_distance": F.when(none | F.col("shift_share").isNull(), "unknown")
                .when(F.col("shift_share") > 0.3, "far")
                .when(F.col("moved_share") > 0.3, "moderate")
                .otherwise("close"),
                "row_delta_pct": F.when(~none, F.col("row_delta_pct")),
                "shift_scope": F.when(none, "unknown").when(share > 0.30, "broad").when(share > 0.10, "narrow").otherwise("stable"),
            }
        )
        .withColumn(
            "likely_cause",
            F.when(none, "unknown")
            .when(F.col("shift_scope") == "stable", "none")
            .when(big_row_move, "sampling_change")
            .when(F.col("coordinated"), "organic_population_change")
            .otherwise("mixed_or_pipeline"),
        )
        .select(
            TABLE, "shift_scope", "likely_cause", "coordinated", "drifted_count", "total_features",
            F.coalesce("drifted_features", F.array().cast("array<string>")).alias("drifted_features"),
            "v1_distance", "row_delta_pct",
        )
    )


def population_refined(i4: DataFrame) -> DataFrame:
    """Cause refined by the share of drifted features and the row move."""
    share = F.col("drifted_count") / F.greatest(F.col("total_features"), F.lit(1))
    return i4.withColumn("sampling_signal", F.coalesce(F.abs("row_delta_pct") > 20, F.lit(False))).withColumn(
        "refined_cause",
        F.when((share > 0.3) & F.col("sampling_signal"), "sampling_shift_confirmed")
        .when(F.col("coordinated") & (share > 0.3), "true_population_shift")
        .when(share < 0.1, "noise_or_local")
        .otherwise("mixed_shift"),
    )


# ── I5 target ───────────────────────────────────────────────────────────────────────────────────


def target_stability(tables: DataFrame, rates: DataFrame, c5: DataFrame, c3: DataFrame, c6: DataFrame) -> DataFrame:
    """Is label drift data loss, a changed definition or a real move."""
    ends = rates.groupBy(*COLUMN).agg(
        F.max(F.when(F.col("ver_idx") == 0, F.col("event_rate"))).alias("event_rate_first"),
        F.max_by("event_rate", F.struct("ver_idx")).alias("event_rate_last"),
    )
    moves = c5.groupBy(*COLUMN).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.sum("delta_pp"), 2).alias("total_drift_pp"),
        F.max("abs_delta_pp").alias("max_single_jump_pp"),
    )
    worse = c6.where("mismatch_trend = 'regressing'").select(*COLUMN, F.lit(True).alias("mismatch_up"))
    bad = F.coalesce(F.col("missing_pattern").isin(*vocab.BAD_PATTERNS), F.lit(False))
    moving = F.coalesce(F.col("n_pairs"), F.lit(0)) > 0
    jump = F.col("max_single_jump_pp")
    found = (
        ends.join(moves, COLUMN, "left")
        .join(c3.select(*COLUMN, "missing_pattern"), COLUMN, "left")
        .join(worse, COLUMN, "left")
        .withColumns(
            {
                "data_loss_risk": moving & bad,
                "label_change_risk": moving & (F.coalesce("mismatch_up", F.lit(False)) | (jump > 5.0)),
            }
        )
        .withColumn(
            "drift_type",
            F.when(~moving, "stable")
            .when(F.col("data_loss_risk"), "data_loss")
            .when(F.col("label_change_risk"), "label_change")
            .when((F.col("n_pairs") >= 2) & (jump < 3.0), "organic_gradual")
            .otherwise("organic_jump"),
        )
        .withColumnRenamed("column_name", "target_column")
    )
    return (
        tables.select(TABLE)
        .join(found, TABLE, "left")
        .select(
            TABLE,
            F.col("target_column").isNotNull().alias("target_found"),
            "target_column",
            "drift_type",
            F.coalesce("label_change_risk", F.lit(False)).alias("label_change_risk"),
            F.coalesce("data_loss_risk", F.lit(False)).alias("data_loss_risk"),
            "event_rate_first",
            "event_rate_last",
            F.when(F.col("target_column").isNotNull(), F.coalesce("total_drift_pp", F.lit(0.0))).alias("total_drift_pp"),
            "max_single_jump_pp",
            "missing_pattern",
        )
    )


def target_refined(i5: DataFrame) -> DataFrame:
    """Confirmed reason of the label drift."""
    return i5.withColumn(
        "refined_drift_type",
        F.when(F.col("data_loss_risk"), "data_loss_confirmed")
        .when(safe(F.col("max_single_jump_pp")) > 5, "label_definition_change")
        .when(F.abs(safe(F.col("total_drift_pp"))) > 5, "real_population_shift")
        .otherwise(F.col("drift_type")),
    )


# ── I6 features ─────────────────────────────────────────────────────────────────────────────────


def feature_impact(c8: DataFrame, c3: DataFrame, c4: DataFrame, metrics: DataFrame) -> DataFrame:
    """Data loss or a real cause for each column whose index moved."""
    last = suite_scope(metrics).where("last_pair").select(
        *COLUMN,
        F.abs(F.round("median_shift", 4)).alias("median_abs"),
        F.abs(F.round("upper_shift", 4)).alias("upper_abs"),
        F.abs(F.round("lower_shift", 4)).alias("lower_abs"),
        F.round("std_change", 4).alias("std_norm"),
    )
    loss = F.coalesce(F.col("missing_pattern").isin(*vocab.BAD_PATTERNS), F.lit(False))
    order = Window.partitionBy(TABLE).orderBy(F.desc("is_real_drift"), "column_name")
    cause = (
        F.when(~F.col("is_real_drift"), "data_loss")
        .when((F.col("median_abs") > 0.20) | (F.abs("mean_delta") > 0.10), "center_shift")
        .when((F.col("upper_abs") > 0.10) | (F.col("lower_abs") > 0.10), "boundary_expansion")
        .when(F.col("std_norm") > 0.25, "spread_change")
        .otherwise("distribution_shift")
    )
    c = F.col("drift_cause")
    return (
        c8.where(F.col("worst_label").isin("shift", "monitor"))
        .join(c3.select(*COLUMN, "missing_pattern"), COLUMN, "left")
        .join(c4.select(*COLUMN, F.col("last_mean_delta").alias("mean_delta")), COLUMN, "left")
        .join(last, COLUMN, "left")
        .fillna(0.0, ["mean_delta", "median_abs", "upper_abs", "lower_abs", "std_norm"])
        .withColumn("is_real_drift", ~loss)
        .withColumn("drift_cause", cause)
        .withColumns(
            {
                "impact_rank": F.row_number().over(order),
                "model_impact": text.lookup(c, text.CAUSE_IMPACT),
                "fix": text.lookup(c, text.CAUSE_FIX),
            }
        )
        .select(
            *COLUMN, "first_version", "first_seq", F.col("worst_label").alias("psi_label"), "last_psi", "missing_pattern",
            "is_real_drift", "drift_cause", "mean_delta", "median_abs", "upper_abs", "lower_abs", "std_norm",
            "model_impact", "fix", "impact_rank",
        )
    )


def feature_refined(i6: DataFrame) -> DataFrame:
    """Mechanisms that act together."""
    acting = F.concat_ws(
        "+",
        keep_when(
            ((F.col("median_abs") > 0.2) | (F.abs("mean_delta") > 0.1), F.lit("center_shift")),
            (F.col("upper_abs") > 0.1, F.lit("boundary_expansion")),
            (F.col("std_norm") > 0.25, F.lit("spread_change")),
        ),
    )
    return i6.withColumn(
        "drift_mechanism",
        F.when(~F.col("is_real_drift"), "data_loss").when(acting == "", "weak_shift").otherwise(acting),
    )


# ── I7 action ───────────────────────────────────────────────────────────────────────────────────


def _feature_facts(i6: DataFrame) -> DataFrame:
    real = F.col("is_real_drift")
    return i6.groupBy(TABLE).agg(
        F.count(F.lit(1)).alias("impact_count"),
        F.count_if(real).alias("real_drift_count"),
        F.count_if(real & (F.col("drift_cause") == "center_shift")).alias("center_count"),
        F.count_if(real & (F.col("drift_cause") == "boundary_expansion")).alias("boundary_count"),
        F.array_sort(F.collect_list(F.when(real, F.col("column_name")))).alias("drifted_columns"),
    )


def _stability_facts(d11: DataFrame, places: DataFrame) -> DataFrame:
    return (
        d11.join(places, COLUMN)
        .groupBy(TABLE)
        .agg(
            _list(F.col("velocity") > 0.05).alias("accelerating_cols"),
            _list(F.col("fsi") < vocab.FSI_MONITOR).alias("unstable_cols"),
        )
    )


def model_action(c0: DataFrame, i5: DataFrame, i6: DataFrame, d11: DataFrame, places: DataFrame) -> DataFrame:
    """Hold, recalibrate, rebin or retrain; the first rung of the ladder that fits."""
    names = F.array().cast("array<string>")
    v, kind = F.col("verdict"), F.coalesce(F.col("drift_type"), F.lit(""))
    real, total = F.col("real_drift_count"), F.abs(safe(F.col("total_drift_pp")))
    rung = (
        F.when(v == "BLOCK", "quality_block")
        .when(v == "CLEAR", "no_drift")
        .when(F.col("data_loss_only"), "features_lost_data")
        .when(kind == "data_loss", "labels_lost_data")
        .when(kind == "label_change", "label_redefined")
        .when((kind == "organic_jump") | (F.col("target_found") & (total > 5.0)), "target_moved")
        .when((real > 0) & (F.col("center_count") == real), "centers_moved")
        .when(F.col("boundary_count") > 0, "limits_moved")
        .when(F.size("unstable_cols") > 0, "chronically_unstable")
        .otherwise("manageable")
    )
    r = F.col("rung")
    return (
        c0.select(TABLE, "verdict")
        .join(i5.select(TABLE, "target_found", "drift_type", "total_drift_pp"), TABLE, "left")
        .join(_feature_facts(i6), TABLE, "left")
        .join(_stability_facts(d11, places), TABLE, "left")
        .withColumns(
            {
                **_zero("impact_count", "real_drift_count", "center_count", "boundary_count"),
                **{c: F.coalesce(c, names) for c in ["accelerating_cols", "unstable_cols", "drifted_columns"]},
            }
        )
        .withColumn("data_loss_only", (F.col("real_drift_count") == 0) & (F.col("impact_count") > 0))
        .withColumn("rung", rung)
        .withColumns(
            {
                "decision": F.when(r.isin("quality_block", "no_drift", "features_lost_data", "labels_lost_data"), "hold")
                .when(r.isin("label_redefined", "target_moved"), "retrain")
                .when(r == "manageable", "recalibrate")
                .otherwise("rebin"),
                "urgency": F.when(r == "no_drift", "none")
                .when(r.isin("quality_block", "features_lost_data", "labels_lost_data"), "pipeline_fix_first")
                .when(r == "label_redefined", "immediate")
                .otherwise("next_cycle"),
            }
        )
        .withColumn("steps", text.lookup_list(F.col("decision"), text.DECISION_STEPS))
        .drop("center_count", "boundary_count")
    )


def action_refined(i7: DataFrame, i5c: DataFrame, i6c: DataFrame) -> DataFrame:
    """Corrections in order: label change, pure data loss, acceleration, instability."""
    loss = i6c.groupBy(TABLE).agg(F.bool_and(F.col("drift_mechanism") == "data_loss").alias("all_loss"))
    d = F.col("refined_decision")
    return (
        i7.join(i5c.select(TABLE, "refined_drift_type"), TABLE, "left")
        .join(loss, TABLE, "left")
        .withColumn("velocity_flag", F.size("accelerating_cols") > 0)
        .withColumn(
            "refined_decision",
            F.when(F.coalesce("all_loss", F.lit(True)), "hold")
            .when(F.col("refined_drift_type") == "label_definition_change", "retrain")
            .otherwise(F.col("decision")),
        )
        .withColumn("refined_decision", F.when((d == "recalibrate") & F.col("velocity_flag"), "rebin").otherwise(d))
        .withColumn("refined_decision", F.when((d == "retrain") & (F.size("unstable_cols") > 0), "rebin").otherwise(d))
        .drop("all_loss")
    )


# ── I8 break risks ──────────────────────────────────────────────────────────────────────────────


def break_risks(c2: DataFrame, c10: DataFrame, metrics: DataFrame) -> DataFrame:
    """I8: what would break scoring on the latest version."""
    empty = F.lit(None).cast("double")
    schema = c2.where(F.col("last_pair") & (F.col("change") != "added")).select(
        *COLUMN,
        F.when(F.col("change") == "dropped", "dropped_feature").otherwise("type_mismatch").alias("risk"),
        F.lit("critical").alias("severity"),
        empty.alias("measure"),
    )
    latest = Window.partitionBy(*COLUMN).orderBy(F.desc("pair_idx"))
    cards = (
        c10.withColumn("rn", F.row_number().over(latest))
        .where((F.col("rn") == 1) & F.col("severity").isin("critical", "notable"))
        .select(*COLUMN, F.lit("cardinality_explosion").alias("risk"), "severity", F.col("ratio").alias("measure"))
    )
    limits = (
        suite_scope(metrics)
        .where(F.col("last_pair") & (F.col("boundary_severity") == "critical"))
        .where((F.abs(F.round("upper_shift", 4)) >= 0.25) | (F.abs(F.round("lower_shift", 4)) >= 0.25))
        .select(
            *COLUMN,
            F.lit("range_extrapolation").alias("risk"),
            F.lit("notable").alias("severity"),
            F.round("max_boundary_shift", 4).alias("measure"),
        )
    )
    order = Window.partitionBy(TABLE).orderBy(F.col("severity") != "critical", "column_name", "risk")
    return (
        schema.unionByName(cards)
        .unionByName(limits)
        .withColumns({"risk_rank": F.row_number().over(order), "fix": text.lookup(F.col("risk"), text.RISK_FIX)})
    )


def risks_refined(i8: DataFrame) -> DataFrame:
    """How soon each risk needs attention."""
    return i8.withColumn(
        "priority",
        F.when(F.col("risk").isin("type_mismatch", "dropped_feature"), "immediate_fix")
        .when(F.col("severity") == "critical", "urgent")
        .otherwise("monitor"),
    )


# ── I9 feed health ──────────────────────────────────────────────────────────────────────────────


def feed_health(c3: DataFrame, c6: DataFrame, dataset: DataFrame) -> DataFrame:
    """Are upstream feeds degrading, for one column or across the table."""
    worsening = F.col("missing_pattern").isin(*vocab.DEGRADING_PATTERNS)
    is_ = lambda p: F.col("missing_pattern") == p
    quality = c6.where("mismatch_trend = 'regressing' or blank_trend = 'regressing'").select(
        *COLUMN, F.lit(True).alias("quality_down")
    )
    prefix = F.when(F.instr("column_name", "_") > 0, F.element_at(F.split(F.lower("column_name"), "_"), 1))
    feeds = (
        c3.where(worsening)
        .withColumn("prefix", prefix)
        .where("prefix is not null")
        .groupBy(TABLE, "prefix")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first_version", "first_seq")).alias("place"))
        .groupBy(TABLE)
        .agg(F.min_by(F.struct("prefix", "n"), F.struct(-F.col("n"), F.col("place"))).alias("top"))
        .select(TABLE, F.when(F.col("top.n") >= 2, F.col("top.prefix")).alias("shared_prefix"))
    )
    place = F.when(worsening, F.struct("first_version", "first_seq"))
    per_table = (
        c3.join(quality, COLUMN, "left")
        .groupBy(TABLE)
        .agg(
            F.count(F.lit(1)).alias("total_cols"),
            F.count_if(worsening).alias("degrading_count"),
            F.count_if(is_("recovering")).alias("recovering_count"),
            F.count_if(is_("sparse")).alias("sparse_count"),
            F.count_if("quality_down").alias("regressing_count"),
            _list(worsening).alias("affected_columns"),
            _list(is_("sparse")).alias("sparse_columns"),
            _list(is_("recovering")).alias("recovering_columns"),
            _list(F.col("quality_down")).alias("quality_regressing"),
            F.min_by("first_gap_version", place).alias("first_seen"),
        )
    )
    n, delta = F.col("degrading_count"), F.col("health_score_delta")
    return (
        per_table.join(dataset.select(TABLE, "n_versions", F.col("score_delta").alias("health_score_delta")), TABLE)
        .join(feeds, TABLE, "left")
        .withColumn(
            "is_systematic",
            (n / F.greatest(F.col("total_cols"), F.lit(1)) > 0.20)
            | ((n >= 3) & (F.col("n_versions") >= 3))
            | (F.col("regressing_count") >= 3),
        )
        .withColumn(
            "pattern",
            F.when(F.col("is_systematic") & (delta < -5), "systematic")
            .when((n > 0) & ~F.col("is_systematic"), "isolated")
            .when((n == 0) & (F.col("recovering_count") > 0), "recovering")
            .when(delta > 3, "improving")
            .otherwise("stable"),
        )
        .withColumns(
            {
                "feed_health": F.when(F.col("pattern").isin("systematic", "isolated"), "degrading").otherwise(F.col("pattern")),
                "escalate": F.col("pattern") == "systematic",
                "first_seen_version": F.when((n > 0) & (F.col("n_versions") >= 2), F.col("first_seen")),
            }
        )
        .drop("first_seen")
    )


def feed_refined(i9: DataFrame, strict_parity: bool = False) -> DataFrame:
    """Systemic or localized failure, against all columns (or, strictly, the degrading ones)."""
    n = F.col("degrading_count")
    whole = F.greatest(n if strict_parity else F.col("total_cols"), F.lit(1))
    return i9.withColumn(
        "failure_mode",
        F.when(n > 0.2 * whole, "systemic_failure").when(n > 0, "localized_failure").otherwise("healthy"),
    )


# ── tier B: the same answers with their history ─────────────────────────────────────────────────


def dataset_history(s0: DataFrame) -> DataFrame:
    """Readiness scores of each table in version order."""
    return s0.groupBy(TABLE).agg(
        F.array_sort(F.collect_list(F.struct("version", "abt_name", "score", "readiness_label"))).alias("dataset_scores")
    )


def with_history(df: DataFrame, history: DataFrame) -> DataFrame:
    """An answer per table with the dataset score history."""
    return df.join(history, TABLE, "left").withColumn("narrative", F.lit(None).cast("string"))


def population_history(i4c: DataFrame, history: DataFrame, dataset: DataFrame) -> DataFrame:
    """I4b."""
    return with_history(i4c.join(dataset.select(TABLE, "trend_slope", "trend_direction"), TABLE), history)


def drifted_score_history(i4: DataFrame, g: DataFrame) -> DataFrame:
    """I4b rows: health score series of the drifted features."""
    drifted = i4.select(TABLE, F.explode("drifted_features").alias("column_name"))
    return g.join(drifted, COLUMN, "left_semi").select(*COLUMN, "ver_idx", "ver_name", F.col("p.score").alias("score"))


def target_history(i5c: DataFrame, rates: DataFrame) -> DataFrame:
    """Event rate series."""
    series = rates.groupBy(TABLE).agg(
        F.array_sort(F.collect_list(F.struct("ver_idx", "ver_name", "event_rate"))).alias("rate_series")
    )
    return i5c.join(series, TABLE, "left").withColumn("narrative", F.lit(None).cast("string"))


def feature_history(i6c: DataFrame, metrics: DataFrame) -> DataFrame:
    """Index series over the pairs that have one."""
    series = (
        metrics.where("psi_applicable")
        .groupBy(*COLUMN)
        .agg(F.array_sort(F.collect_list(F.struct("pair_idx", "from_ver", "to_ver", "psi", "psi_label"))).alias("psi_series"))
    )
    return i6c.join(series, COLUMN, "left").withColumn("narrative", F.lit(None).cast("string"))
