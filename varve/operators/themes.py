"""Signals grouped into business themes, with the worst numbers of each theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve import vocab
from varve.functions import text
from varve.functions.scalars import num, signed
from varve.operators.compare import TABLE

THEME = [TABLE, "theme_id"]


def theme_of() -> Column:
    """H1: first rule that fits the signal."""
    m, d = F.col("metric_type"), F.col("direction")
    return (
        F.when(m.isin("schema", "missingness") | (F.col("root_cause") == "pipeline_issue"), "pipeline_failure")
        .when(m == "cardinality", "new_segments")
        .when((F.abs("velocity") > 0.10) | (F.col("fsi") < vocab.FSI_MONITOR), "volatility")
        .when(m == "boundary", "boundary_expansion")
        .when(m == "std", "spread_change")
        .when(d == "down", "center_shift_down")
        .when(d == "up", "center_shift_up")
        .when(F.col("mean_delta_pct") >= 0, "center_shift_up")
        .otherwise("center_shift_down")
    )


def assign_themes(signals: DataFrame) -> DataFrame:
    return signals.withColumn("theme_id", theme_of())


def _worst(field: str) -> Column:
    """Largest value by size, the stronger signal winning ties."""
    c = F.col(field)
    return F.max_by(c, F.when(c.isNotNull(), F.struct(F.abs(c), -F.col("signal_rank"))))


def _top(field: str) -> Column:
    """Value of the strongest signal of the theme, NULL if it has none there."""
    return F.min_by(F.struct(field), "signal_rank").getField(field)


def themes(assigned: DataFrame) -> DataFrame:
    """H2–H4: one row per table and theme with merged facts, strongest theme first."""
    order = Window.partitionBy(TABLE).orderBy(F.desc("max_importance"), "first_rank")
    pct = F.col("mean_delta_pct")
    means = F.max_by(
        F.struct("mean_before", "mean_after"), F.when(pct.isNotNull(), F.struct(F.abs(pct), -F.col("signal_rank")))
    )
    return (
        assigned.groupBy(*THEME)
        .agg(
            F.min("signal_rank").alias("first_rank"),
            F.count(F.lit(1)).alias("n_columns"),
            F.array_sort(F.collect_list(F.struct("signal_rank", "column_name"))).getField("column_name").alias("columns"),
            F.max("magnitude").alias("max_importance"),
            _top("column_name").alias("worst_column"),
            _top("severity").alias("worst_severity"),
            F.max("psi").alias("worst_psi"),
            _top("psi_label").alias("worst_psi_label"),
            _top("psi_worst_pair").alias("worst_psi_pair"),
            _worst("mean_delta_pct").alias("worst_mean_delta_pct"),
            means.alias("means"),
            _worst("median_shift").alias("worst_median_shift"),
            _worst("q1_shift").alias("worst_q1_shift"),
            _worst("q3_shift").alias("worst_q3_shift"),
            F.min_by("iqr_base", F.when(F.col("iqr_base").isNotNull(), F.col("signal_rank"))).alias("iqr_base"),
            *[_top(c).alias(c) for c in ["min_base", "min_new", "max_base", "max_new", "std_base", "std_new"]],
            _worst("std_change").alias("worst_std_change"),
            *[_top(c).alias(c) for c in ["completeness_before", "completeness_after", "baseline_label", "fsi_label"]],
            F.max("baseline_psi").alias("baseline_psi"),
            _worst("velocity").alias("worst_velocity"),
            F.min("fsi").alias("worst_fsi"),
        )
        .withColumns(
            {
                "mean_before": F.col("means.mean_before"),
                "mean_after": F.col("means.mean_after"),
                "theme_label": text.lookup(F.col("theme_id"), vocab.THEME_LABELS),
                "theme_domain": text.lookup(F.col("theme_id"), vocab.THEME_DOMAINS),
                "theme_rank": F.row_number().over(order),
            }
        )
        .drop("means", "first_rank")
    )


def fact_sheet(th: DataFrame) -> DataFrame:
    """H5: known facts of a theme as lines of text."""
    line = lambda cond, *parts: F.when(cond, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    known = lambda *cs: [F.col(c).isNotNull() for c in cs]
    both = lambda a, b: known(a)[0] & known(b)[0]
    c = F.col
    lines = [
        line(F.lit(True), "theme: ", c("theme_id")),
        line(F.lit(True), "columns: ", F.concat_ws(", ", "columns")),
        line(known("worst_psi")[0], "index: ", num(c("worst_psi"), 3), " (", F.coalesce("worst_psi_label", F.lit("?")), ")"),
        line(both("mean_before", "mean_after"), "mean: ", num(c("mean_before"), 4), " to ", num(c("mean_after"), 4), ", ", signed(c("worst_mean_delta_pct"), 1), "%"),
        line(known("worst_median_shift")[0], "median shift: ", signed(c("worst_median_shift"), 3), " IQR"),
        line(known("worst_q1_shift")[0], "Q1 shift: ", signed(c("worst_q1_shift"), 3), " IQR"),
        line(known("worst_q3_shift")[0], "Q3 shift: ", signed(c("worst_q3_shift"), 3), " IQR"),
        line(both("max_base", "max_new"), "range: ", num(c("min_base"), 2), "..", num(c("max_base"), 2), " to ", num(c("min_new"), 2), "..", num(c("max_new"), 2)),
        line(both("worst_std_change", "std_base"), "std: ", num(c("std_base"), 4), " to ", num(c("std_new"), 4)),
        line(both("completeness_before", "completeness_after"), "complete: ", num(c("completeness_before"), 1), "% to ", num(c("completeness_after"), 1), "%"),
        line(known("baseline_psi")[0], "against first version: ", num(c("baseline_psi"), 3)),
        line(known("worst_velocity")[0], "velocity: ", signed(c("worst_velocity"), 4), F.when(c("worst_velocity") > 0.05, " (accelerating)").otherwise("")),
        line(known("worst_fsi")[0], "stability: ", num(c("worst_fsi"), 3)),
    ]
    return th.select(
        *THEME,
        F.concat_ws("\n", *lines).alias("fact_sheet"),
        F.size(F.array_compact(F.array(*lines))).alias("n_lines"),
    )


def theme_cards(th: DataFrame, i7: DataFrame, limit: int = 5) -> DataFrame:
    """B1: the top themes as cards; the action follows the model decision."""
    parts = F.concat_ws(
        ", ",
        F.when(F.col("worst_psi").isNotNull(), F.concat(F.lit("PSI="), num(F.col("worst_psi"), 3))),
        F.when(F.col("worst_mean_delta_pct").isNotNull(), F.concat(F.lit("mean "), signed(F.col("worst_mean_delta_pct"), 1), F.lit("%"))),
        F.when(F.col("worst_median_shift").isNotNull(), F.concat(F.lit("median "), signed(F.col("worst_median_shift"), 3), F.lit(" IQR"))),
    )
    actions = {
        "retrain": "Retrain on the latest version.",
        "rebin": "Refit bins of the affected columns.",
        "recalibrate": "Recalibrate the decision threshold.",
        "hold": "Watch the next version.",
    }
    return (
        th.where(F.col("theme_rank") <= limit)
        .join(i7.select(TABLE, "decision"), TABLE, "left")
        .select(
            TABLE,
            "theme_rank",
            "theme_id",
            "theme_domain",
            F.col("theme_label").alias("headline"),
            F.when(F.col("worst_severity") == "critical", "critical").when(F.col("worst_severity") == "notable", "high").otherwise("medium").alias("severity"),
            F.concat_ws(": ", F.concat_ws(", ", "columns"), parts).alias("evidence"),
            text.lookup(F.coalesce("decision", F.lit("hold")), actions).alias("action"),
            F.coalesce("decision", F.lit("hold")).alias("decision"),
            F.col("worst_psi").alias("psi"),
            "n_columns",
        )
    )


def fallback_cards(rules: DataFrame, limit: int = 5) -> DataFrame:
    """B2: the first rule signals as cards."""
    return rules.where(F.col("rule_rank") <= limit)
