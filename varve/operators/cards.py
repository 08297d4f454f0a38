"""Decision cards: drift stories, four structured cards, their order and their validation.

A card is (table, slot, severity, headline, impact_and_action, evidence rows). Numbers come from the
facts that every signal carries, so no card reads a text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve import vocab
from varve.functions import text
from varve.functions.scalars import num, safe, signed
from varve.operators.compare import TABLE
from varve.operators.signals import slot_signals, top_population

STORY_ACTIONS = {
    "schema_event": "Compare the deployed feature list with this schema before scoring.",
    "cardinality_explosion": "Refit WoE bins or the encoder and add a bucket for unseen levels.",
    "data_loss": "Fix the data pipeline; the index should then fall below its threshold.",
    "center_shift": "Rebin the feature on the latest version; no full retrain.",
    "boundary_expansion": "Extend the capping rule and inspect records at the new extremes.",
    "spread_change": "Refit the scaler; no retrain.",
    "distribution_shift": "Watch it; refit preprocessing if the index stays above its threshold.",
}
STORY_IMPACT = {
    "schema_event": "Scoring misses or misreads a model input without an error.",
    "cardinality_explosion": "Unseen levels fall into a default bin.",
    "data_loss": "No genuine model impact.",
    "center_shift": "Bins anchored to the old centre score records wrongly.",
    "boundary_expansion": "The model extrapolates beyond its training range.",
    "spread_change": "Scalers fitted on the old spread are off.",
    "distribution_shift": "Predictions in this range may be unreliable.",
}
STORY_HEADLINES = {
    "schema_event": "a model input was removed or changed its type",
    "cardinality_explosion": "new categories appeared that the model never saw",
    "data_loss": "apparent changes come from missing data, not from customers",
    "center_shift": "the typical value of a key feature moved",
    "boundary_expansion": "values outside the trained range appeared",
    "spread_change": "the variability of a key feature changed",
    "distribution_shift": "the profile of a key feature changed",
}
TARGET_ACTIONS = {
    "stable": "No action on the target.",
    "data_loss": "Restore target completeness, then compare again.",
    "label_change": "Confirm the label change; a full retrain on later data is needed.",
    "organic_gradual": "Recalibrate the decision threshold; a retrain is not needed yet.",
    "organic_jump": "Back-test at once and retrain if performance fell.",
}
TARGET_HEADLINES = {
    "stable": "the outcome rate is stable",
    "data_loss": "the outcome rate moved only because labels are missing",
    "label_change": "the outcome rate jumped as if the label were redefined",
    "organic_gradual": "the outcome rate drifts slowly",
    "organic_jump": "the outcome rate moved sharply",
}
DECISION_ACTIONS = {
    "quality_block": "Fix data quality first; do not retrain on degraded data.",
    "no_drift": "Keep monitoring.",
    "features_lost_data": "Fix the data pipeline; do not retrain or recalibrate.",
    "labels_lost_data": "Restore labels; do not retrain until they are complete.",
    "label_redefined": "Retrain on data after the label change only.",
    "target_moved": "Back-test, refit bins and retrain on the latest version.",
    "centers_moved": "Rebin the moved features; do not retrain.",
    "limits_moved": "Rebin and recalibrate; do not retrain.",
    "chronically_unstable": "Drop or rebin unstable features; do not retrain with them.",
    "manageable": "Recalibrate the threshold; do not retrain.",
}
# Replacement actions of the validation rules, by decision.
ALLOWED_ACTIONS = {
    "hold": "Nothing to change yet: compare again when the next version arrives.",
    "recalibrate": "Set the threshold anew on recently scored rows.",
    "rebin": "Rebin from the newest rows, then hold old scores against new ones.",
    "retrain": "Retrain on the newest rows and test on rows the model has not seen.",
}
FEED_FIX = "Values went missing on the way in: mend the feed, then compare again."
BLOCK_FIX = "Too much of this version is unusable: clean the data, then look again."
SIGN_OFF = "Ask governance for a sign-off before this step. "
CARD = [TABLE, "slot", "title", "severity", "headline", "impact_and_action", "evidence"]


def row(label, detail) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(label).alias("label"), as_col(detail).alias("detail"))


def rows_of(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, r) for cond, r in pairs]))


# ── B3–B6 drift stories ─────────────────────────────────────────────────────────────────────────


def diagnosed(signals: DataFrame) -> DataFrame:
    """Root cause of each signal; data loss only shows in metrics that read completeness."""
    m = F.col("metric_type")
    reads_gaps = m.isin("psi", "mean_shift", "missingness")
    loss = reads_gaps & F.coalesce(F.col("missing_pattern").isin(*vocab.BAD_PATTERNS), F.lit(False))
    size = lambda c: F.abs(safe(F.col(c)))
    cause = (
        F.when(m == "schema", "schema_event")
        .when(m == "cardinality", "cardinality_explosion")
        .when(loss, "data_loss")
        .when((size("median_shift") > 0.20) | (size("last_mean_delta") > 0.10), "center_shift")
        .when((size("upper_shift") > 0.10) | (size("lower_shift") > 0.10), "boundary_expansion")
        .when(safe(F.col("std_change")) > 0.25, "spread_change")
        .otherwise("distribution_shift")
    )
    c = F.col("drift_cause")
    return signals.withColumn("drift_cause", cause).withColumns(
        {
            "is_real_drift": c != "data_loss",
            "cause_summary": F.concat_ws(
                " ",
                F.col("column_name"),
                F.regexp_replace(c, "_", " "),
                F.when(m == "psi", F.concat(F.lit("PSI "), num(F.col("psi"), 3))),
                F.when(c == "center_shift", F.concat(F.lit("mean "), signed(safe(F.col("last_mean_delta")), 4))),
            ),
            "model_impact": text.lookup(c, STORY_IMPACT),
            "fix": text.lookup(c, STORY_ACTIONS),
        }
    )


def evidence_rows(sig: DataFrame) -> DataFrame:
    """Ordered evidence of a diagnosed signal, at most two supporting metrics."""
    m, c, name = F.col("metric_type"), F.col("drift_cause"), F.col("column_name")
    support = lambda i: F.col("supporting")[i]
    has_mean = F.exists("supporting", lambda s: s["metric_type"] == "mean_shift")
    label = lambda t: F.concat(F.lit(t), name)
    extra = lambda i: (
        F.coalesce(F.size("supporting") > i, F.lit(False)),
        row(F.concat(F.lit("Seen as well: "), F.get("supporting", F.lit(i))["metric_type"]), F.get("supporting", F.lit(i))["severity"]),
    )
    ev = rows_of(
        (m == "psi", row(label("PSI "), F.concat(num(safe(F.col("psi")), 3), F.lit(" "), F.coalesce("psi_label", F.lit("shift"))))),
        (
            (m == "psi") & F.coalesce(has_mean, F.lit(False)),
            row(label("Centre "), F.concat(F.lit("mean move "), signed(safe(F.col("last_mean_delta")), 4))),
        ),
        (m == "mean_shift", row(label("Mean shift "), F.concat(F.lit("move "), signed(safe(F.col("last_mean_delta")), 4)))),
        (m == "missingness", row(label("Completeness "), F.coalesce("missing_pattern", F.lit("unknown")))),
        (m == "cardinality", row(label("Cardinality "), F.concat_ws(" to ", F.col("card_from"), F.col("card_to")))),
        (m == "schema", row(label("Schema change "), F.col("change"))),
        (
            c == "center_shift",
            row("Where in the distribution", F.concat(F.lit("median "), num(F.abs(safe(F.col("median_shift"))), 2), F.lit(" IQR"))),
        ),
        (c == "boundary_expansion", row("Range", F.concat(F.lit("upper "), num(F.abs(safe(F.col("upper_shift"))) * 100, 0), F.lit("% of base range")))),
        (c == "spread_change", row("Spread", F.concat(F.lit("change "), num(safe(F.col("std_change")) * 100, 0), F.lit("%")))),
        (F.lit(True), row("Root cause", F.when(c == "data_loss", F.concat("cause_summary", F.lit(": data loss, not drift"))).otherwise(F.col("cause_summary")))),
        (F.lit(True), row("Model impact", F.col("model_impact"))),
        extra(0),
        extra(1),
    )
    return sig.withColumn("evidence", ev)


def drift_stories(signals: DataFrame, stage: str = "back_testing", stories: int = 3) -> DataFrame:
    """The strongest population signals as cards."""
    sig = evidence_rows(diagnosed(top_population(signals, stories)))
    urgency = F.when(F.col("severity") == "critical", "materially").otherwise("noticeably")
    return sig.select(
        TABLE,
        F.concat(F.lit("drift_story_"), F.col("slot_rank")).alias("slot"),
        F.concat(F.lit("Strongest movement no. "), F.col("slot_rank")).alias("title"),
        F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "notable", "warning").otherwise("stable").alias("severity"),
        F.concat_ws(
            ", ", F.lit(vocab.STAGE_CONTEXT.get(stage, "In the current data")), text.lookup(F.col("drift_cause"), STORY_HEADLINES), urgency
        ).alias("headline"),
        F.concat_ws(": ", F.lit(vocab.STAGE_ACTION.get(stage, "Action required")), F.col("fix")).alias("impact_and_action"),
        "evidence",
        "column_name",
        "metric_type",
        "drift_cause",
        "is_real_drift",
        "magnitude",
    )


def story_facts(signals: DataFrame) -> DataFrame:
    """The facts behind each drift story as columns."""
    return diagnosed(top_population(signals, 3)).select(
        TABLE, "slot_rank", "column_name", "metric_type", "drift_cause", "root_cause", "psi", "mean_before", "mean_after",
        "mean_delta", "median_shift", "upper_shift", "lower_shift", "std_change", "card_from", "card_to",
        "completeness_before", "completeness_after",
    )


# ── B7–B10 structured cards ─────────────────────────────────────────────────────────────────────


def _card(df: DataFrame, slot: str, title: str, severity: Column, headline: Column, action: Column, evidence: Column, default: Column, stage: str) -> DataFrame:
    ctx = F.lit(vocab.STAGE_CONTEXT.get(stage, "In the current data"))
    act = F.lit(vocab.STAGE_ACTION.get(stage, "Action required"))
    return (
        df.withColumn("evidence", evidence)
        .withColumn("evidence", F.when(F.size("evidence") == 0, F.array(default)).otherwise(F.col("evidence")))
        .select(
            TABLE,
            F.lit(slot).alias("slot"),
            F.lit(title).alias("title"),
            severity.alias("severity"),
            F.concat_ws(", ", ctx, headline).alias("headline"),
            F.concat_ws(": ", act, action).alias("impact_and_action"),
            "evidence",
        )
    )


def target_card(i5: DataFrame, c5: DataFrame, stage: str = "back_testing") -> DataFrame:
    """Behaviour of the outcome."""
    moves = (
        c5.where("severity <> 'stable'")
        .groupBy(TABLE)
        .agg(
            F.array_sort(F.collect_list(F.struct("pair_idx", "from_ver", "to_ver", "delta_pp", "severity"))).alias("moves")
        )
    )
    kind = F.col("drift_type")
    jump = safe(F.col("max_single_jump_pp"))
    pair_rows = F.transform(
        "moves",
        lambda m: row(
            F.concat(F.lit("Pairwise drift "), m["from_ver"], F.lit(" to "), m["to_ver"]),
            F.concat(signed(m["delta_pp"], 2), F.lit("pp "), m["severity"]),
        ),
    )
    ev = F.concat(
        rows_of(
            (
                F.col("event_rate_first").isNotNull() & F.col("event_rate_last").isNotNull(),
                row("Event rate change", F.concat(F.col("event_rate_first").cast("string"), F.lit("% to "), F.col("event_rate_last").cast("string"), F.lit("%"))),
            ),
            (jump > 0, row("Biggest step between versions", F.concat(num(jump, 1), F.lit("pp")))),
        ),
        F.coalesce(pair_rows, F.array().cast("array<struct<label:string,detail:string>>")),
        rows_of(
            (F.col("data_loss_risk"), row("Data loss flag", "target completeness is falling")),
            (F.col("target_found"), row("Model impact", text.lookup(kind, TARGET_HEADLINES))),
        ),
    )
    severity = F.when(kind.isin("organic_jump", "label_change"), "critical").when(kind.isin("organic_gradual", "data_loss"), "warning").otherwise("stable")
    return _card(
        i5.join(moves, TABLE, "left"), "target_behavior", "How the outcome moves", severity,
        F.coalesce(text.lookup(kind, TARGET_HEADLINES), F.lit("no target column detected")),
        F.coalesce(text.lookup(kind, TARGET_ACTIONS), F.lit("Name a target column.")),
        ev, row("Status", "no target column"), stage,
    )


def feed_card(i9: DataFrame, signals: DataFrame, stage: str = "back_testing", shown: int = 4) -> DataFrame:
    """Quality of the data supply, with the first ``shown`` affected columns."""
    hits = (
        diagnosed(slot_signals(signals, "pipeline").where(F.col("slot_rank") <= shown))
        .groupBy(TABLE)
        .agg(F.array_sort(F.collect_list(F.struct("slot_rank", "column_name", "drift_cause", "cause_summary"))).alias("hits"))
    )
    hit_rows = F.transform(
        "hits",
        lambda h: row(
            F.concat(F.lit("Completeness "), h["column_name"]),
            F.when(h["drift_cause"] == "data_loss", F.concat(h["cause_summary"], F.lit(": data loss, not drift"))).otherwise(h["cause_summary"]),
        ),
    )
    ev = F.concat(
        rows_of((F.col("health_score_delta").isNotNull(), row("Health score, first to last", signed(F.col("health_score_delta"), 1)))),
        F.coalesce(hit_rows, F.array().cast("array<struct<label:string,detail:string>>")),
        rows_of((F.col("regressing_count") > 0, row("More blanks or wrong formats in", F.concat_ws(", ", "quality_regressing")))),
    )
    pattern = F.col("pattern")
    severity = F.when(pattern == "systematic", "critical").when(pattern == "isolated", "warning").otherwise("stable")
    headline = (
        F.when((F.col("feed_health") == "stable") & (F.col("regressing_count") == 0), "the data supply is healthy")
        .when(pattern == "recovering", "columns with gaps are recovering")
        .when(pattern == "systematic", "data quality degrades across columns")
        .when(pattern == "isolated", "single columns have completeness problems")
        .otherwise("minor quality signals")
    )
    action = (
        F.when(F.col("escalate"), "Escalate to data engineering and do not train until completeness is back.")
        .when(pattern == "isolated", "Check the source of the affected columns.")
        .when(pattern == "recovering", "Verify completeness in the next version.")
        .otherwise("Keep monitoring.")
    )
    return _card(
        i9.join(hits, TABLE, "left"), "pipeline_quality", "Health of the data supply", severity, headline, action, ev,
        row("Pipeline status", "all checks passed"), stage,
    )


def risk_card(i6: DataFrame, i7: DataFrame, i8: DataFrame, signals: DataFrame, stage: str = "back_testing", shown: int = 4) -> DataFrame:
    """Risk of scoring with the current model, with the first ``shown`` break risks."""
    breaks = (
        i8.where(F.col("risk_rank") <= shown)
        .groupBy(TABLE)
        .agg(F.array_sort(F.collect_list(F.struct("risk_rank", "risk", "column_name"))).alias("breaks"))
    )
    told = signals.where("slot = 'population'").select(TABLE, "column_name")
    more = (
        i6.where("is_real_drift")
        .join(told, [TABLE, "column_name"], "left_anti")
        .groupBy(TABLE)
        .agg(F.array_sort(F.collect_list(F.struct("impact_rank", "column_name", "drift_cause"))).alias("more"))
    )
    none = F.array().cast("array<struct<label:string,detail:string>>")
    ev = F.concat(
        F.coalesce(F.transform("breaks", lambda b: row(F.concat(F.lit("Scoring break risk: "), b["risk"]), b["column_name"])), none),
        F.coalesce(F.transform("more", lambda m: row(F.concat(F.lit("Additional drift: "), m["column_name"]), m["drift_cause"])), none),
        rows_of(
            (F.size("accelerating_cols") > 0, row("Moving faster each version", F.concat_ws(", ", "accelerating_cols"))),
            (F.size("unstable_cols") > 0, row("Moving in every version", F.concat_ws(", ", "unstable_cols"))),
        ),
    )
    d, lost = F.col("decision"), F.col("data_loss_only")
    severity = F.when(lost, "warning").when(d == "retrain", "critical").when(d.isin("rebin", "recalibrate"), "warning").otherwise("stable")
    headline = (
        F.when(lost, "distribution flags come from lost data only")
        .when(d == "hold", "the model should keep performing")
        .when(d == "recalibrate", "the decision cut-off no longer fits the outcome rate")
        .when(d == "rebin", F.concat(F.col("real_drift_count").cast("string"), F.lit(" features have stale bins")))
        .otherwise("the population moved beyond what the model learned")
    )
    return _card(
        i7.join(breaks, TABLE, "left").join(more, TABLE, "left"), "model_scoring_risk", "Risk of keeping the model", severity,
        headline, text.lookup(F.col("rung"), DECISION_ACTIONS), ev, row("Model risk status", "no scoring risk found"), stage,
    )


def governance_card(tables: DataFrame, signals: DataFrame, stage: str = "back_testing") -> DataFrame:
    """Private columns that moved."""
    moved = F.col("metric_type").isin("psi", "mean_shift", "quantile_shift", "boundary", "std", "kurtosis", "entropy")
    hits = (
        diagnosed(slot_signals(signals, "governance"))
        .groupBy(TABLE)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(moved).alias("n_moved"),
            F.array_sort(F.collect_list(F.struct("slot_rank", "column_name", "metric_type", "cause_summary", "model_impact"))).alias("hits"),
        )
    )
    pairs = F.flatten(
        F.transform(
            "hits",
            lambda h: F.array(
                row(F.concat(F.lit("Private attribute "), h["column_name"], F.lit(" "), h["metric_type"]), h["cause_summary"]),
                row("Fairness risk", h["model_impact"]),
            ),
        )
    )
    some = F.coalesce(F.col("n"), F.lit(0)) > 0
    severity = F.when(~some, "stable").when(F.col("n_moved") > 0, "critical").otherwise("warning")
    return _card(
        tables.select(TABLE).join(hits, TABLE, "left"), "governance_fairness", "Private attributes that moved", severity,
        F.when(some, F.concat(F.col("n").cast("string"), F.lit(" governance checkpoints need attention"))).otherwise("no governance signals"),
        F.when(some, "Obtain governance sign-off for all flagged private attributes and run a fairness review.").otherwise("No governance action; keep monitoring."),
        F.coalesce(pairs, F.array().cast("array<struct<label:string,detail:string>>")),
        row("Governance status", "all checks passed"), stage,
    )


# ── B11, B12 order ──────────────────────────────────────────────────────────────────────────────


def ordered_cards(stories: DataFrame, structured: list[DataFrame]) -> DataFrame:
    """Critical target and feed cards first, each replacing one story from the front."""
    cards = reduce(DataFrame.unionByName, [stories.select(*CARD), *[s.select(*CARD) for s in structured]])
    fixed = ["target_behavior", "pipeline_quality", "model_scoring_risk", "governance_fairness"]
    place = reduce(lambda acc, kv: acc.when(F.col("slot") == kv[1], kv[0]), list(enumerate(fixed))[1:], F.when(F.col("slot") == fixed[0], 0))
    pinned = F.col("slot").isin(*fixed[:2]) & (F.col("severity") == "critical")
    story_no = F.when(F.col("slot").startswith("drift_story_"), F.substring("slot", 13, 2).cast("int"))
    whole = Window.partitionBy(TABLE)
    order = whole.orderBy("zone", "inner")
    return (
        cards.withColumns({"pinned": pinned, "story_no": story_no})
        .withColumn("n_pinned", F.sum(F.col("pinned").cast("int")).over(whole))
        .where(F.col("story_no").isNull() | (F.col("story_no") > F.col("n_pinned")))
        .withColumns(
            {
                "zone": F.when(F.col("pinned"), 0).when(F.col("story_no").isNotNull(), 1).otherwise(2),
                "inner": F.coalesce(F.col("story_no"), place),
            }
        )
        .withColumn("card_order", F.row_number().over(order))
        .select(*CARD, "card_order")
    )


# ── V1 validation ───────────────────────────────────────────────────────────────────────────────


def action_rank(words: Column) -> Column:
    """Strongest action a text implies."""
    low = F.lower(words)
    mentions = lambda ws: reduce(lambda a, b: a | b, [low.contains(w) for w in ws])
    return F.when(mentions(vocab.ACTION_WORDS[4]), 4).when(mentions(vocab.ACTION_WORDS[3]), 3).when(mentions(vocab.ACTION_WORDS[2]), 2).otherwise(1)


def validated(cards: DataFrame, i7: DataFrame, c0: DataFrame) -> DataFrame:
    """V1: six rules in order; a rule that fires rewrites the action and is noted."""
    detail, label = (lambda e: F.lower(e["detail"])), (lambda e: F.lower(e["label"]))
    loss = F.exists(
        "evidence",
        lambda e: detail(e).contains("data loss")
        | label(e).contains("pipeline")
        | (detail(e).contains("missing") & detail(e).contains("pipeline")),
    )
    private = F.exists("evidence", lambda e: label(e).contains("private"))
    ranks = lambda c: text.lookup(c, {k: str(v) for k, v in vocab.DECISION_RANK.items()}).cast("int")
    action, verdict = F.col("action"), F.col("verdict")

    df = (
        cards.join(i7.select(TABLE, "decision"), TABLE, "left")
        .join(c0.select(TABLE, "verdict"), TABLE, "left")
        .withColumns(
            {
                "is_private": F.coalesce(private, F.lit(False)),
                "has_loss": F.coalesce(loss, F.lit(False)),
                "rank0": action_rank(F.col("impact_and_action")),
                "decision_rank": ranks(F.coalesce("decision", F.lit("hold"))),
                "ceiling": F.coalesce(text.lookup(verdict, vocab.VERDICT_CEILING), F.lit("recalibrate")),
                "action": F.col("impact_and_action"),
            }
        )
    )

    def rule(df: DataFrame, no: int, fires: Column, new: Column) -> DataFrame:
        return df.withColumn(f"r{no}", F.coalesce(fires, F.lit(False))).withColumn(
            "action", F.when(F.col(f"r{no}"), new).otherwise(action)
        )

    df = rule(df, 1, F.col("is_private") & F.lower("impact_and_action").contains("drop"), F.replace(action, F.lit("drop"), F.lit("review with governance")))
    df = rule(df, 2, F.col("has_loss") & (F.col("rank0") >= 2), F.lit(FEED_FIX))
    df = rule(df, 3, F.col("slot").startswith("drift_story") & (F.col("rank0") > F.col("decision_rank")), text.lookup(F.col("decision"), ALLOWED_ACTIONS))
    df = rule(df, 4, action_rank(action) > ranks(F.col("ceiling")), text.lookup(F.col("ceiling"), ALLOWED_ACTIONS))
    df = rule(df, 5, (F.col("slot") == "governance_fairness") & ~F.lower(action).contains("sign-off"), F.concat(F.lit(SIGN_OFF), action))
    df = rule(df, 6, (verdict == "BLOCK") & (F.col("rank0") >= 2), F.lit(BLOCK_FIX))
    fired = F.concat_ws(" | ", *[F.when(F.col(f"r{i}"), name) for i, name in enumerate(RULE_NAMES, 1)])
    return (
        df.withColumns(
            {
                "fired_rules": fired,
                "validation_passed": fired == "",
                "impact_and_action": action,
                "original_rank": F.col("rank0"),
                "final_rank": action_rank(action),
            }
        )
        .select(*CARD, "card_order", "is_private", "has_loss", "original_rank", "final_rank", "fired_rules", "validation_passed")
    )


# Names of the six rules as they appear in notes.
RULE_NAMES = [
    "PRIVATE_DROP_BLOCKED",
    "DATA_LOSS_MODEL_ACTION_BLOCKED",
    "DRIFT_STORY_EXCEEDS_I7",
    "EXCEEDS_VERDICT_CEILING",
    "GOVERNANCE_SIGNOFF_MISSING",
    "BLOCK_VERDICT_MODEL_ACTION_BLOCKED",
]
