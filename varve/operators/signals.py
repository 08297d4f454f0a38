"""Ranked drift signals: one per column, plus schema events.

All numbers of a column are gathered into one wide row of facts; a signal is then chosen inside that
row with array functions, so scoring and ranking metrics of a column needs no further shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve import vocab
from varve.config import Thresholds
from varve.functions.scalars import is_target, rank_in, safe
from varve.operators.compare import TABLE
from varve.operators.pairs import COLUMN

COMPOSITE = ["psi", "mean_shift", "quantile_shift", "boundary", "std"]


def private_columns(sc: DataFrame) -> DataFrame:
    """Columns flagged private in any compared version."""
    return sc.groupBy(*COLUMN).agg(F.bool_or("g_privacy").alias("is_private"))


def raw_facts(
    metrics: DataFrame, d11: DataFrame, baseline: DataFrame, c3: DataFrame, c4: DataFrame, c10: DataFrame, private: DataFrame
) -> DataFrame:
    """Worst index, latest pair and long-run numbers of every column in one row."""
    suite = (
        F.col("base").isNotNull()
        & ~F.col("base.statistical_scale").isin(*vocab.SUITE_SKIP_SCALES)
        & ~is_target(F.col("column_name"))
    )
    measure = (
        (F.col("base.data_type") == "num")
        & ~F.col("base.statistical_scale").isin(*vocab.NON_DISTRIBUTION_SCALES)
        & ~is_target(F.col("column_name"))
    )
    last = lambda c: F.max(F.when(F.col("last_pair"), c))
    latest = lambda c: F.max(F.when(F.col("last_pair") & suite, c))
    numeric = lambda s: F.when(measure & (F.col(f"{s}.data_type") == "num"), F.col(f"{s}.mean"))
    span = F.col("lower_shift").isNotNull()
    # the first pair wins among equal indexes
    worst = F.when(F.col("psi_applicable"), F.struct("psi", -F.col("pair_idx")))
    per_column = metrics.groupBy(*COLUMN, "first_version", "first_seq").agg(
        F.max_by(F.struct("psi", "psi_label", "from_ver", "to_ver"), worst).alias("top"),
        latest(F.col("psi_label")).alias("latest_label"),
        last(numeric("a")).alias("mean_before"),
        last(numeric("b")).alias("mean_after"),
        last(F.col("a.completeness_percent")).alias("completeness_before"),
        last(F.col("b.completeness_percent")).alias("completeness_after"),
        *[latest(F.round(c, 4)).alias(c) for c in ["q1_shift", "median_shift", "q3_shift", "iqr_base"]],
        latest(F.col("worst_quantile")).alias("worst_quantile"),
        *[
            latest(F.when(span, F.col(f"{s}.{f}_val"))).alias(f"{f}_{n}")
            for s, n in [("a", "base"), ("b", "new")]
            for f in ["min", "max"]
        ],
        *[latest(F.round(c, 4)).alias(c) for c in ["upper_shift", "lower_shift", "std_change", "cv_base", "cv_new", "cv_change"]],
        *[
            latest(F.when(F.col("std_change").isNotNull(), F.round(F.col(f"{s}.std"), 4))).alias(f"std_{n}")
            for s, n in [("a", "base"), ("b", "new")]
        ],
        *[latest(F.col(f"{m}_severity")).alias(f"{m}_severity") for m in ["quantile", "boundary", "std", "kurtosis"]],
        *[latest(F.col(c)).alias(c) for c in ["entropy_change"]],
    )
    far = baseline.groupBy(*COLUMN).agg(
        F.max_by(F.struct("psi", "psi_label"), "pair_idx").alias("far"),
    )
    kind = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "notable", 1).otherwise(0)
    cards = c10.groupBy(*COLUMN).agg(
        F.max(kind).alias("card_rank"),
        (F.max_by("severity", "pair_idx") == "dropped").alias("card_dropped"),
        F.max_by("ratio", "pair_idx").alias("card_ratio"),
        F.max_by("from_card", "pair_idx").alias("card_from"),
        F.max_by("to_card", "pair_idx").alias("card_to"),
    )
    before = F.col("mean_before")
    return (
        per_column.join(far, COLUMN, "left")
        .join(d11.select(*COLUMN, "fsi", "fsi_label", F.round("mean_psi", 4).alias("fsi_mean_psi"), "velocity", "velocity_label"), COLUMN, "left")
        .join(c3.select(*COLUMN, "missing_pattern", "net_delta"), COLUMN, "left")
        .join(c4.select(*COLUMN, "overall_severity", "last_mean_delta", "last_drift_score", "flag_count"), COLUMN, "left")
        .join(cards, COLUMN, "left")
        .join(private, COLUMN, "left")
        .withColumns(
            {
                "psi": F.col("top.psi"),
                "psi_label": F.coalesce("top.psi_label", "latest_label"),
                "psi_worst_pair": F.when(F.col("top").isNotNull(), F.concat("top.from_ver", F.lit("→"), "top.to_ver")),
                "baseline_psi": F.col("far.psi"),
                "baseline_label": F.col("far.psi_label"),
                "mean_delta": F.round(F.col("mean_after") - before, 4),
                "mean_delta_pct": F.when(
                    F.abs(before) > 1e-9, F.round(F.try_divide(F.col("mean_after") - before, F.abs(before)) * 100, 2)
                ),
                "is_private": F.coalesce("is_private", F.lit(False)),
            }
        )
        .drop("top", "far", "latest_label")
    )


def weight_of(severity: Column, metric: str) -> Column:
    """Severity weight × metric weight × privacy bonus, at most 1."""
    sev = reduce(
        lambda acc, kv: acc.when(severity == kv[0], kv[1]),
        list(vocab.SEVERITY_WEIGHT.items())[1:],
        F.when(severity == "critical", vocab.SEVERITY_WEIGHT["critical"]),
    ).otherwise(0.1)
    bonus = F.when(F.col("is_private"), 1.0 + vocab.PRIVACY_BONUS).otherwise(1.0)
    return F.round(F.least(F.lit(1.0), sev * vocab.METRIC_WEIGHT[metric] * bonus), 4)


def composite_importance() -> Column:
    """Half index, three tenths mean move, two tenths quantile move."""
    index = F.least(safe(F.col("psi")) / 0.50, F.lit(1.0))
    mean = F.least(F.abs(safe(F.col("mean_delta_pct"))) / 30.0, F.lit(1.0))
    quant = F.least(F.greatest(*[F.abs(safe(F.col(c))) for c in ["q1_shift", "median_shift", "q3_shift"]]), F.lit(1.0))
    bonus = F.when(F.col("is_private"), 1.0 + vocab.PRIVACY_BONUS).otherwise(1.0)
    return F.round(F.least(F.lit(1.0), (0.50 * index + 0.30 * mean + 0.20 * quant) * bonus), 4)


def _severities() -> dict[str, Column]:
    """Severity of each metric of a column, NULL when the metric raises nothing (G1)."""
    free = ~is_target(F.col("column_name"))
    raised = lambda c: F.when(F.col(c).isin("notable", "critical"), F.col(c))
    pattern = F.col("missing_pattern")
    return {
        "psi": F.when(free & (F.col("psi_label") == "shift"), "critical").when(
            free & (F.col("psi_label") == "monitor"), "notable"
        ),
        "mean_shift": F.when(F.col("flag_count") > 0, raised("overall_severity")),
        "missingness": F.when(free & pattern.isin(*vocab.DEGRADING_PATTERNS), "critical").when(
            free & (pattern == "sparse"), "notable"
        ),
        "cardinality": F.when(F.col("card_rank") == 2, "critical").when(F.col("card_rank").isNotNull(), "notable"),
        "quantile_shift": raised("quantile_severity"),
        "boundary": raised("boundary_severity"),
        "std": raised("std_severity"),
        "kurtosis": raised("kurtosis_severity"),
    }


def metric_rows(facts: DataFrame) -> DataFrame:
    """G1: one row per column and raised metric."""
    items = [
        F.when(sev.isNotNull(), F.struct(F.lit(m).alias("metric_type"), sev.alias("severity"), weight_of(sev, m).alias("magnitude")))
        for m, sev in _severities().items()
    ]
    return facts.select(*COLUMN, "is_private", F.inline(F.array_compact(F.array(*items))))


def root_cause(metric: Column) -> Column:
    """G4."""
    return (
        F.when((metric == "missingness") | F.coalesce(F.col("missing_pattern").isin(*vocab.BAD_PATTERNS), F.lit(False)), "pipeline_issue")
        .when(F.abs("row_delta_pct") > 20, "sampling_change")
        .when(F.col("likely_cause").isin("organic_population_change", "organic_shift"), "organic_shift")
        .when(F.col("likely_cause") == "sampling_change", "sampling_change")
        .otherwise("unknown")
    )


def slot(metric: Column, cause: Column, private: Column) -> Column:
    """G5."""
    return (
        F.when((metric == "schema") & ~private, "model_risk")
        .when(private, "governance")
        .when((cause == "pipeline_issue") | (metric == "missingness"), "pipeline")
        .otherwise("population")
    )


def direction(metric: Column) -> Column:
    """G6."""
    grows = F.coalesce((F.col("upper_shift") > 0) | (F.col("lower_shift") < 0), F.lit(False))
    return (
        F.when(metric == "mean_shift", F.when(safe(F.col("last_mean_delta")) > 0, "up").otherwise("down"))
        .when(metric == "psi", "shift")
        .when(metric == "missingness", "down")
        .when(metric == "cardinality", F.when(F.col("card_dropped"), "dropped").otherwise("expand"))
        .when(metric == "boundary", F.when(grows, "expand").otherwise("contract"))
        .when(metric == "std", F.when(safe(F.col("std_new")) > safe(F.col("std_base")), "expand").otherwise("contract"))
        .otherwise("mixed")
    )


def _adjusted(metric: str, severity: Column, composite: bool, cfg: Thresholds) -> Column:
    base = weight_of(severity, metric)
    has_index = F.col("s_psi").isNotNull() & F.col("psi").isNotNull()
    quiet = has_index & (F.col("psi") <= cfg.psi_stable)
    if composite and metric in COMPOSITE:
        return F.col("composite")
    if metric == "psi":
        loud = has_index & (F.col("psi") > cfg.psi_stable)
        boost = F.least(F.lit(4.0), F.col("psi") / cfg.psi_monitor)
        return F.when(loud, F.round(F.least(F.lit(1.0), base * boost), 4)).otherwise(F.round(base * 0.1, 4))
    return F.when(quiet, F.round(base * 0.25, 4)).otherwise(base)


def column_signals(facts: DataFrame, i4: DataFrame, composite: bool = False, cfg: Thresholds = Thresholds()) -> DataFrame:
    """G3 (or G13 with ``composite``): best metric of each column, the others as support."""
    order = {m: i for i, m in enumerate(vocab.TIE_ORDER)}
    scored = facts.withColumns({f"s_{m}": s for m, s in _severities().items()}).withColumn("composite", composite_importance())
    entries = []
    for m in _severities():
        sev = F.col(f"s_{m}")
        mag = _adjusted(m, sev, composite, cfg)
        entries.append(
            F.when(
                sev.isNotNull(),
                F.struct(
                    (-mag).alias("minus"), F.lit(order[m]).alias("tie"), F.lit(m).alias("metric_type"),
                    sev.alias("severity"), mag.alias("magnitude"),
                ),
            )
        )
    metric = F.col("metric_type")
    return (
        scored.withColumn("ranked", F.array_sort(F.array_compact(F.array(*entries))))
        .where(F.size("ranked") > 0)
        .withColumns(
            {
                "metric_type": F.col("ranked")[0]["metric_type"],
                "severity": F.col("ranked")[0]["severity"],
                "magnitude": F.col("ranked")[0]["magnitude"],
                "supporting": F.transform(
                    F.slice("ranked", 2, 8),
                    lambda e: F.struct(e["metric_type"].alias("metric_type"), e["severity"].alias("severity"), e["magnitude"].alias("magnitude")),
                ),
            }
        )
        .join(i4.select(TABLE, "row_delta_pct", "likely_cause"), TABLE, "left")
        .withColumn("root_cause", root_cause(metric))
        .withColumns({"direction": direction(metric), "slot": slot(metric, F.col("root_cause"), F.col("is_private"))})
        .drop("ranked", "row_delta_pct", "likely_cause", *[f"s_{m}" for m in _severities()])
    )


def schema_signals(c2: DataFrame, facts: DataFrame) -> DataFrame:
    """Columns the latest version lost or retyped."""
    events = c2.where(F.col("last_pair") & (F.col("change") != "added")).select(*COLUMN, "change", "from_type", "to_type")
    severity = F.lit("critical")
    return (
        events.join(facts.select(*COLUMN, "first_version", "first_seq", "is_private"), COLUMN)
        .withColumns(
            {
                "metric_type": F.lit("schema"),
                "severity": severity,
                "magnitude": weight_of(severity, "schema"),
                "root_cause": F.lit("schema_event"),
                "direction": F.when(F.col("change") == "dropped", "dropped").otherwise("mixed"),
            }
        )
        .withColumn("slot", slot(F.col("metric_type"), F.col("root_cause"), F.col("is_private")))
    )


def collect_signals(facts: DataFrame, c2: DataFrame, i4: DataFrame, composite: bool = False, cfg: Thresholds = Thresholds()) -> DataFrame:
    """G9 (G13 with ``composite``): all signals of a table, strongest first."""
    order = Window.partitionBy(TABLE).orderBy(
        F.desc("magnitude"), rank_in(F.col("metric_type"), vocab.TIE_ORDER), "first_version", "first_seq"
    )
    return (
        column_signals(facts, i4, composite, cfg)
        .unionByName(schema_signals(c2, facts), allowMissingColumns=True)
        .withColumn("signal_rank", F.row_number().over(order))
    )


def slot_signals(signals: DataFrame, name: str) -> DataFrame:
    """Signals of one slot with their rank inside it."""
    inside = Window.partitionBy(TABLE).orderBy("signal_rank")
    return signals.where(F.col("slot") == name).withColumn("slot_rank", F.row_number().over(inside))


def top_population(signals: DataFrame, n: int = 3) -> DataFrame:
    return slot_signals(signals, "population").where(F.col("slot_rank") <= n)


def slot_severity(signals: DataFrame) -> DataFrame:
    """Which slots hold a critical or notable signal."""
    has = lambda s: F.bool_or(F.col("severity") == s)
    return signals.groupBy(TABLE, "slot").agg(
        F.count(F.lit(1)).alias("signals"), has("critical").alias("has_critical"), has("notable").alias("has_notable")
    )


# ── G14 rule signals ────────────────────────────────────────────────────────────────────────────


def rule_signals(c0_issues, c0, i4, i5, i6, i7, i8, i9, c8) -> DataFrame:
    """Flat list of what the sections report, worst first; a low CLEAR row when nothing does."""
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def rows(df, source, domain, severity, cause, column=no_text, psi=no_number) -> DataFrame:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select(
            TABLE,
            F.lit(source).alias("source"),
            F.lit(domain).alias("domain"),
            as_col(severity).alias("severity"),
            as_col(cause).alias("cause"),
            column.alias("column_name"),
            psi.alias("psi"),
        )

    name, urgency, kind = F.col("column_name"), F.col("urgency"), F.col("drift_type")
    shifted = F.col("psi_label") == "shift"
    parts = [
        rows(
            c0_issues.where(F.col("verdict").isin("BLOCK", "BACK_TEST_REQUIRED")),
            "c0_verdict", "population",
            F.when(F.col("verdict") == "BLOCK", "critical").otherwise("high"), F.col("issue"),
        ),
        rows(
            i7.where("decision <> 'hold' or urgency = 'pipeline_fix_first'"),
            "i7_model_action", "population",
            F.when(urgency == "immediate", "critical").when(urgency == "next_cycle", "high")
            .when(urgency == "pipeline_fix_first", "medium").otherwise("low"),
            "drift_or_label_change",
        ),
        rows(i7.select(TABLE, F.explode("accelerating_cols").alias("column_name")), "i7_drift_velocity", "feature", "high", "accelerating_drift", name),
        rows(i7.select(TABLE, F.explode("unstable_cols").alias("column_name")), "i7_fsi_unstable", "feature", "medium", "chronic_instability", name),
        rows(
            i5.where(F.col("target_found") & (kind != "stable")),
            "i5_target_stability", "target",
            F.when(kind == "label_change", "critical").when(kind.isin("organic_jump", "data_loss"), "high").otherwise("medium"),
            kind, F.col("target_column"),
        ),
        rows(
            i4.where(F.col("shift_scope").isin("broad", "narrow")),
            "i4_population_shift", "population",
            F.when((F.col("shift_scope") == "broad") & (F.col("v1_distance") == "far"), "critical")
            .when(F.col("shift_scope") == "broad", "high").otherwise("medium"),
            F.col("likely_cause"),
        ),
        rows(i6.where("is_real_drift"), "i6_feature_drift", "feature", F.when(shifted, "critical").otherwise("medium"), F.col("drift_cause"), name),
        rows(i6.where("not is_real_drift"), "i6_data_loss_psi", "pipeline", "medium", "data_loss", name),
        rows(
            c8.where(F.col("worst_label").isin("shift", "monitor")).join(i6.select(*COLUMN), COLUMN, "left_anti"),
            "c8_psi_matrix", "feature", F.when(F.col("worst_label") == "shift", "high").otherwise("medium"),
            "distribution_shift", name, F.col("max_psi"),
        ),
        rows(i8, "i8_pipeline_break", "pipeline", F.when(F.col("severity") == "critical", "critical").otherwise("high"), F.col("risk"), name),
        rows(i9.where("feed_health = 'degrading'"), "i9_pipeline_health", "pipeline", F.when(F.col("escalate"), "critical").otherwise("high"), "pipeline_degradation"),
    ]
    raised = reduce(DataFrame.unionByName, parts)
    quiet = c0.join(raised.select(TABLE).distinct(), TABLE, "left_anti")
    everything = raised.unionByName(rows(quiet, "c0_clear", "population", "low", "none"))
    order = Window.partitionBy(TABLE).orderBy(
        rank_in(F.col("severity"), ["critical", "high", "medium", "low"]),
        F.desc(F.coalesce("psi", F.lit(0.0))),
        rank_in(F.col("source"), vocab.RULE_SOURCES),
        F.coalesce("column_name", F.lit("")),
        "cause",
    )
    return everything.withColumn("rule_rank", F.row_number().over(order))
