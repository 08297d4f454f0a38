"""One plain sentence per section, rendered from the numbers already in its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.scalars import num, signed
from varve.operators.compare import TABLE

SENTENCE = ["table_name", "subject", "section", "sentence"]


def _words(c: str) -> Column:
    return F.regexp_replace(F.col(c), "_", " ")


def _say(df: DataFrame, section: str, subject: Column, *parts) -> DataFrame:
    as_col = lambda p: p if isinstance(p, Column) else F.lit(p)
    return df.select(
        TABLE,
        subject.cast("string").alias("subject"),
        F.lit(section).alias("section"),
        F.concat(*[F.coalesce(as_col(p).cast("string"), F.lit("n/a")) for p in parts]).alias("sentence"),
    )


def narratives(ws) -> DataFrame:
    """Sentences of S0, S6, C0, C8, the version story and the tier-B interpretations."""
    c = F.col
    whole = F.lit("table")
    parts = [
        _say(ws.s0, "S0", c("version"), "readiness ", num(c("score"), 1), " of 100, ", _words("readiness_label"), ", blocked ", c("blocked_cols")),
        _say(ws.s6, "S6", c("version"), "event rate ", num(c("event_rate"), 2), "%, ", c("balance_label")),
        _say(ws.c0, "C0", whole, "verdict ", _words("verdict"), ", issues ", c("issue_count")),
        _say(ws.c8_summary, "C8", whole, "shifted ", c("shift_count"), ", to watch ", c("monitor_count"), ", stable ", c("stable_count")),
        _say(ws.c9_dataset, "versions", whole, "score ", num(c("first_score"), 1), " to ", num(c("last_score"), 1), ", ", _words("trend_direction")),
        _say(ws.i4b, "I4b", whole, c("drifted_count"), " of ", c("total_features"), " features drifted, ", _words("refined_cause")),
        _say(ws.i5b.where("target_found"), "I5b", whole, "target moved ", signed(c("total_drift_pp"), 2), "pp, ", _words("drift_type")),
        _say(ws.i6b, "I6b", c("column_name"), _words("drift_cause"), ", PSI ", num(c("last_psi"), 4)),
        _say(ws.i7b, "I7b", whole, _words("refined_decision"), ", urgency ", _words("urgency")),
        _say(ws.i9b, "I9b", whole, "feeds ", c("feed_health"), ", ", _words("failure_mode")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
