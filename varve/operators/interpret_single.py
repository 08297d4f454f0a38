"""Interpretation of one version: what to do with each column, and whether training can start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve import vocab
from varve.functions import text
from varve.functions.scalars import rank_in, safe
from varve.operators.single import VERSION


def _same_version(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by table and version, where no version equals no version."""
    other = right.withColumnsRenamed({"table_name": "of_table", "version": "of_version"})
    same = (F.col("table_name") == F.col("of_table")) & F.col("version").eqNullSafe(F.col("of_version"))
    return left.join(other, same, how).drop("of_table", "of_version")


def _seen_group() -> Column:
    """Columns are listed in the order in which the sections first mention them."""
    return F.when(F.col("blocked"), 0).when(F.col("warned"), 1).when(F.col("governed"), 2).when(F.col("has_shape"), 3).otherwise(4)


def _steps() -> Column:
    """Ordered preprocessing steps as an array of (type, method, amount)."""
    skew = F.when(F.col("has_shape"), F.round("skewness", 4)).otherwise(0.0)
    low = F.col("min_val")
    transform = (
        F.when((skew < -1.0) | (low < 0), "reflect then log1p").when(low > 0, "log").otherwise("log1p")
    )
    step = lambda kind, method, amount: F.struct(
        F.lit(kind).alias("type"), method.alias("method"), amount.cast("bigint").alias("amount")
    )
    none = F.lit(None)
    return F.array_compact(
        F.array(
            F.when(F.col("w_blank"), step("quality_fix", F.lit("blank to null"), F.col("blank_value_count"))),
            F.when(
                F.col("w_partial"),
                step("imputation", F.when(F.abs(skew) > 0.5, "median").otherwise("mean"), F.col("missing_count")),
            ),
            F.when(F.col("w_format"), step("quality_fix", F.lit("unify encoding"), F.col("mismatched_count"))),
            F.when(
                F.col("has_shape") & F.col("has_outliers") & (F.col("n_outliers") > 0),
                step("outlier_cap", F.lit("winsorise"), F.col("n_outliers")),
            ),
            F.when(F.abs(skew) > 1.0, step("transformation", transform, none)),
        )
    )


def feature_verdicts(sc: DataFrame) -> DataFrame:
    """Exclude, drop, fix or use each column; the first rule that fits decides."""
    cause = (
        F.when(F.col("prob_like"), "LEAKAGE")
        .when(F.col("g_identifier"), "IDENTIFIER")
        .when(F.col("g_privacy"), "PRIVACY")
        .when(F.col("b_zero"), "zero_variance")
        .when(F.col("b_missing"), "high_missing")
        .when(F.col("b_mismatch"), "severe_mismatch")
        .when(F.size("steps") > 0, "needs_steps")
        .otherwise("clean")
    )
    c = F.col("cause")
    order = Window.partitionBy(*VERSION).orderBy("verdict_order", "seen_group", "col_seq")
    return (
        sc.withColumns({"steps": _steps(), "seen_group": _seen_group()})
        .withColumn("cause", cause)
        .withColumns(
            {
                "verdict": F.when(c.isin("LEAKAGE", "PRIVACY"), "exclude")
                .when(c == "needs_steps", "fix_then_use")
                .when(c == "clean", "use")
                .otherwise("drop"),
                "effort": F.when(c == "clean", "none")
                .when(c == "PRIVACY", "high")
                .when(c.isin("high_missing", "severe_mismatch"), "medium")
                .when((c == "needs_steps") & (F.size("steps") > 1), "medium")
                .otherwise("low"),
                "steps": F.when(c == "needs_steps", F.col("steps")).otherwise(F.slice("steps", 1, 0)),
                "reason": F.coalesce(
                    text.lookup(c, text.RULE_REASONS),
                    F.when(c == "clean", F.concat(F.lit("no issues, health score "), F.col("score"))),
                    F.concat(F.size("steps"), F.lit(" preprocessing steps needed")),
                ),
            }
        )
        .withColumn("verdict_order", rank_in(F.col("verdict"), vocab.VERDICT_ORDER))
        .withColumn("verdict_rank", F.row_number().over(order))
        .select(
            *VERSION, "col_seq", "column_name", "verdict", "cause", "effort", "score", "reason", "steps", "seen_group",
            "verdict_rank",
        )
    )


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Columns per verdict."""
    return verdicts.groupBy(*VERSION, "verdict").agg(F.count(F.lit(1)).alias("columns"))


def training_readiness(s1: DataFrame, s0: DataFrame, s6: DataFrame) -> DataFrame:
    """Can this version be trained on, and with which handling of imbalance."""
    label, balance = F.col("readiness_label"), F.col("balance_label")
    minority = F.bround(F.col("event_rate") / 100 * F.col("row_count")).cast("bigint")
    stop = (
        F.when(label == "not_ready", "dataset_not_ready")
        .when(F.col("target").isNull(), "no_target")
        .when(F.col("error").isNotNull(), "target_error")
        .when(F.col("target_blocked"), "target_blocked")
        .when(F.col("completeness") < 95.0, "target_incomplete")
    )
    n = F.col("minority_count")
    ready = F.col("stop_reason").isNull()
    strategy = (
        F.when(balance == "balanced", "stratified_split")
        .when(balance == "moderate", "class_weight_kfold")
        .when(n < 300, "class_weight_only")
        .when(n < 2000, "class_weight_smote_capped")
        .otherwise("threshold_calibration")
    )
    smote = F.when(balance == "balanced", False).when(balance == "moderate", n > 1000).otherwise((n >= 300) & (n < 2000))
    readiness = s0.select(*VERSION, F.col("score").alias("readiness_score"), "readiness_label")
    targets = s6.select(
        *VERSION, F.col("column_name").alias("target"), "event_rate", "imbalance_ratio", "balance_label",
        "completeness", "error", F.col("blocked").alias("target_blocked"),
    )
    return (
        _same_version(_same_version(s1.select(*VERSION, "row_count"), readiness, "inner"), targets, "left")
        .withColumn("stop_reason", stop)
        .withColumn("minority_count", F.when(ready, minority))
        .withColumns(
            {
                "training_ready": ready,
                "majority_count": F.when(ready, F.col("row_count") - n),
                "strategy": F.when(ready, strategy),
                "smote_recommended": F.coalesce(ready & smote, F.lit(False)),
                "primary_metric": F.when(
                    ready, F.when(balance.isin("balanced", "moderate"), "ROC-AUC").otherwise("Precision-Recall AUC")
                ),
                "secondary_metric": F.when(
                    ready,
                    F.when(balance == "balanced", "F1").when(balance == "moderate", "Precision-Recall AUC").otherwise("ROC-AUC"),
                ),
            }
        )
        .drop("error", "target_blocked")
    )


def preprocessing_checklist(verdicts: DataFrame) -> DataFrame:
    """All steps of fixable columns, numbered by step type, then column."""
    order = Window.partitionBy(*VERSION).orderBy("type_order", "seen_group", "col_seq", "pos")
    return (
        verdicts.where("verdict = 'fix_then_use'")
        .select(*VERSION, "col_seq", "column_name", "seen_group", F.posexplode("steps").alias("pos", "step"))
        .select(*VERSION, "col_seq", "column_name", "seen_group", "pos", "step.*")
        .withColumn("type_order", rank_in(F.col("type"), vocab.STEP_TYPES))
        .withColumn("step_no", F.row_number().over(order))
        .withColumn(
            "instruction",
            F.concat_ws(" ", F.col("type"), F.col("column_name"), F.lit("with"), F.col("method")),
        )
        .select(*VERSION, "step_no", "type", "column_name", "method", "amount", "instruction")
    )
