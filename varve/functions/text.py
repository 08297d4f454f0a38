"""Plain wording for rules, causes and actions. Numbers stay in columns; text is rendered last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE_ACTIONS = {
    "high_missing": "Find out why values are absent before imputing.",
    "zero_variance": "Remove the column before training.",
    "severe_mismatch": "Repair the format at the source.",
    "partial_missing": "Choose and document an imputation.",
    "format_mismatch": "Unify case and encoding.",
    "blank_values": "Turn blank strings into nulls first.",
    "IDENTIFIER": "Keep for joins only, never as a feature.",
    "PRIVACY": "Get governance sign-off and a fairness review.",
    "LEAKAGE": "Check where the values come from before training.",
    "transform": "Apply a log or Box-Cox transform.",
    "winsorise": "Cap values at the 1st and 99th percentile.",
}

RULE_REASONS = {
    "high_missing": "More than half of the values are absent; imputing them would invent data.",
    "zero_variance": "A constant carries no signal.",
    "severe_mismatch": "Values in the wrong format become spurious categories.",
    "partial_missing": "Without one agreed imputation, splits differ from each other.",
    "format_mismatch": "Variants of one category look like several.",
    "IDENTIFIER": "A unique key lets a model memorise rows.",
    "PRIVACY": "Sensitive attributes need a documented justification.",
    "LEAKAGE": "Bounded, many-valued numbers look like the output of another model.",
    "transform": "Strong skew distorts linear and distance based models.",
    "winsorise": "Extreme values dominate coefficient estimates.",
}

READINESS_REASONS = {
    "drop": "Blocked by missing data, zero variance or a severe format problem.",
    "ready": "No issue found.",
}

TARGET_ADVICE = {
    "balanced": ["Standard training applies."],
    "moderate": ["Use stratified splits.", "Consider balanced class weights."],
    "severe": ["Stratified splits are required.", "Consider resampling or a tuned threshold.", "Judge by precision-recall AUC."],
    "unknown": ["Check the values of the target column."],
}

CAUSE_IMPACT = {
    "data_loss": "No genuine model impact; the metric recovers once the feed does.",
    "center_shift": "Bins anchored to the old centre score records wrongly.",
    "boundary_expansion": "The model extrapolates for values outside its training range.",
    "spread_change": "Scalers fitted on the old spread are off.",
    "distribution_shift": "The shape moved; the mechanism is not clear.",
    "schema_change": "Scoring fills the column with nulls or misreads it.",
    "cardinality": "Encoders meet categories they never saw.",
}

CAUSE_FIX = {
    "data_loss": "Restore completeness upstream.",
    "center_shift": "Refit the bins on the latest version.",
    "boundary_expansion": "Extend capping rules to the new range.",
    "spread_change": "Refit the scaler on the latest version.",
    "distribution_shift": "Watch the column and refit preprocessing if it persists.",
    "schema_change": "Compare the deployed feature list with the new schema.",
    "cardinality": "Group rare levels or use target encoding.",
}

RISK_FIX = {
    "dropped_feature": "Check the deployed feature list before scoring this version.",
    "type_mismatch": "Refit preprocessing on the new type.",
    "cardinality_explosion": "Group rare levels or use target encoding.",
    "range_extrapolation": "Extend capping rules to the new range.",
}

VERDICT_MESSAGES = {
    "BLOCK": "Dataset quality is too low to train on.",
    "BACK_TEST_REQUIRED": "Significant drift: back-test the model before any promotion.",
    "MONITOR": "Minor changes: watch the next versions.",
    "CLEAR": "No significant drift across the compared versions.",
}

DECISION_STEPS = {
    "hold": ["Fix upstream data.", "Run the comparison again."],
    "retrain": ["Back-test on the latest version.", "Retrain on current data only.", "Validate on a recent holdout."],
    "rebin": ["Refit bins of the drifted features.", "Recalibrate the threshold.", "Back-test before promotion."],
    "recalibrate": ["Back-test on the latest version.", "Recalibrate the threshold."],
}


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    chain = reduce(
        lambda acc, kv: acc.when(key == kv[0], kv[1]),
        list(table.items())[1:],
        F.when(key == next(iter(table)), table[next(iter(table))]),
    )
    return chain.otherwise(default) if default is not None else chain


def lookup_list(key: Column, table: dict[str, list[str]]) -> Column:
    items = [F.when(key == k, F.array(*[F.lit(s) for s in v])) for k, v in table.items()]
    return F.coalesce(*items)
