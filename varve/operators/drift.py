"""Pairwise and longitudinal drift metrics over the pair table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve import vocab
from varve.config import Thresholds
from varve.functions import psi as P
from varve.functions.scalars import is_target, slope, three_way
from varve.operators.pairs import COLUMN

PAIR = [*COLUMN, "first_version", "first_seq", "n_versions", "pair_idx", "last_pair", "from_ver", "to_ver"]


def _when(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def _label(name: str, value: Column) -> Column:
    return three_way(value, *vocab.METRIC_LIMITS[name])


def _level_metrics() -> dict[str, Column]:
    """Variability, spread, quartiles, limits and tails."""
    A, B = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    numeric = P.both_numeric()
    cv_ok = numeric & (F.abs(A("mean")) >= 1e-6) & (F.abs(B("mean")) > 1e-6) & A("std").isNotNull() & B("std").isNotNull()
    cv_a, cv_b = _when(cv_ok, A("std") / F.abs(A("mean"))), _when(cv_ok, B("std") / F.abs(B("mean")))
    std_ok = numeric & (A("std") >= 1e-9) & B("std").isNotNull()
    quart_ok = numeric
    for q in ("q25", "q50", "q75"):
        quart_ok = quart_ok & A(q).isNotNull() & B(q).isNotNull()
    iqr = F.greatest(A("q75") - A("q25"), F.lit(1e-9))
    moved = {n: _when(quart_ok, (B(q) - A(q)) / iqr) for n, q in zip(["q1", "median", "q3"], ["q25", "q50", "q75"])}
    span_ok = numeric
    for f in ("min_val", "max_val"):
        span_ok = span_ok & A(f).isNotNull() & B(f).isNotNull()
    span = F.greatest(F.abs(A("max_val") - A("min_val")), F.lit(1e-9))
    kurt_ok = numeric & A("kurtosis").isNotNull() & B("kurtosis").isNotNull()
    return {
        "cv_base": cv_a,
        "cv_new": cv_b,
        "std_change": _when(std_ok, F.abs(B("std") - A("std")) / A("std")),
        "std_direction": _when(std_ok, F.when(B("std") > A("std"), "widened").otherwise("narrowed")),
        "iqr_base": _when(quart_ok, iqr),
        **{f"{n}_shift": v for n, v in moved.items()},
        "lower_shift": _when(span_ok, (B("min_val") - A("min_val")) / span),
        "upper_shift": _when(span_ok, (B("max_val") - A("max_val")) / span),
        "kurtosis_delta": _when(kurt_ok, B("kurtosis") - A("kurtosis")),
    }


def pair_metrics(pairs: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """All metrics of a pair in one wide row (D1–D8), over any pair table with ``a`` and ``b``."""
    shifts = ["q1_shift", "median_shift", "q3_shift"]
    names = ["Q1", "Median", "Q3"]
    levels = pairs.withColumns(_level_metrics()).withColumns(
        {
            "cv_change": F.abs(F.col("cv_new") - F.col("cv_base")) / F.greatest("cv_base", F.lit(1e-9)),
            "max_quantile_shift": F.greatest(*[F.abs(s) for s in shifts]),
            "max_boundary_shift": F.greatest(F.abs("lower_shift"), F.abs("upper_shift")),
        }
    )
    df = P.with_ks(P.with_entropy(P.with_union_psi(levels, cfg)))
    return df.withColumns(
        {
            "worst_quantile": F.coalesce(
                *[F.when(F.abs(s) == F.col("max_quantile_shift"), n) for s, n in zip(shifts, names)]
            ),
            "cv_severity": _label("cv_drift", F.col("cv_change")),
            "std_severity": _label("std_drift", F.col("std_change")),
            "quantile_severity": _label("quantile_shift", F.col("max_quantile_shift")),
            "boundary_severity": _label("boundary_drift", F.col("max_boundary_shift")),
            "kurtosis_severity": _label("kurtosis_drift", F.abs("kurtosis_delta")),
            "entropy_severity": _label("entropy_drift", F.col("entropy_change")),
            "ks_severity": _label("ks_approx", F.col("ks")),
        }
    ).drop("new_cdf_1", "new_cdf_2", "new_cdf_3")


#: Columns that hold the value and the verdict of each pair metric.
PAIR_METRICS = {
    "cv_drift": ("cv_change", "cv_severity"),
    "std_drift": ("std_change", "std_severity"),
    "quantile_shift": ("max_quantile_shift", "quantile_severity"),
    "boundary_drift": ("max_boundary_shift", "boundary_severity"),
    "kurtosis_drift": ("kurtosis_delta", "kurtosis_severity"),
    "entropy_drift": ("entropy_change", "entropy_severity"),
    "ks_approx": ("ks", "ks_severity"),
    "psi": ("psi", "psi_label"),
}
ADVICE = {"stable": " No action.", "notable": " Watch it.", "monitor": " Watch it.", "critical": " Look into it before scoring.", "shift": " Look into it before scoring."}


def not_applicable_reason(metric: str) -> Column:
    """Why a metric of a pair has no value; NULL where it has one."""
    absent = F.when(~P.both_present(), "the column is missing from one of the versions")
    unknown = lambda *names: reduce(or_, [F.col(f"{s}.{n}").isNull() for n in names for s in "ab"])
    numeric = absent.when(~P.both_numeric(), "not a numeric column")
    reasons = {
        "cv_drift": numeric.when(unknown("mean", "std"), "mean or spread unknown")
        .when(F.abs("a.mean") < 1e-6, "the earlier mean is about zero")
        .when(F.col("cv_change").isNull(), "the later mean is about zero"),
        "std_drift": numeric.when(unknown("std"), "spread unknown").when(F.col("a.std") < 1e-9, "the earlier spread is about zero"),
        "quantile_shift": numeric.when(unknown("q25", "q50", "q75"), "quartiles unknown"),
        "boundary_drift": numeric.when(unknown("min_val", "max_val"), "limits unknown"),
        "kurtosis_drift": numeric.when(unknown("kurtosis"), "kurtosis unknown"),
        "entropy_drift": absent.when((F.col("a.data_type") == "num") & (F.col("a.statistical_scale") != "binary"), "a numeric column, see its quantiles")
        .when(F.coalesce(F.least("a.cardinality_count", "b.cardinality_count"), F.lit(0)) <= 0, "number of values unknown")
        .when(F.col("entropy_change").isNull(), "one value holds nearly all rows of the earlier version"),
        "ks_approx": numeric.when(F.col("ks").isNull(), "not all of limits and quartiles known"),
        "psi": absent.when(F.col("psi_state") == "not_applicable", F.concat(F.lit("no index for the scale "), F.col("a.statistical_scale")))
        .when(F.col("psi_state") == "insufficient_data", "quartiles unknown"),
    }
    return reasons[metric]


def _hundredths(value: Column) -> Column:
    """A number times 100, rounded, as text."""
    return F.coalesce(F.round(value * 100).try_cast("decimal(38,0)").cast("string"), F.lit("very many"))


def finding(metric: str) -> Column:
    """What a metric of a pair says, in words."""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pct, c = _hundredths, F.col
    texts = {
        "cv_drift": say("Spread went from ", pct(c("cv_base")), " % to ", pct(c("cv_new")), " % of the mean."),
        "std_drift": say("Spread ", c("std_direction"), " by ", pct(c("std_change")), " %."),
        "quantile_shift": say(c("worst_quantile"), " moved most, by ", pct(c("max_quantile_shift")), " % of the earlier interquartile range."),
        "boundary_drift": say("The lower limit moved by ", pct(c("lower_shift")), " %, the upper by ", pct(c("upper_shift")), " % of the earlier range."),
        "kurtosis_drift": say("Tails are ", F.when(c("kurtosis_delta") > 0, "heavier").when(c("kurtosis_delta") < 0, "lighter").otherwise("as before"), ", kurtosis by ", pct(c("kurtosis_delta")), " hundredths."),
        "entropy_drift": say("The mix of values changed its entropy by ", pct(c("entropy_change")), " %."),
        "ks_approx": say("The distributions differ most at ", c("ks_point"), ", by ", pct(c("ks")), " % of the rows."),
        "psi": say("The index is ", pct(c("psi")), " hundredths."),
    }
    return texts[metric]


def metric_notes(metrics: DataFrame) -> DataFrame:
    """One row per pair and metric: metric, value, severity, applicable, note (the finding, or why there is none)."""
    rows = []
    for metric, (value, severity) in PAIR_METRICS.items():
        reason = not_applicable_reason(metric)
        advice = F.coalesce(*[F.when(F.col(severity) == k, v) for k, v in ADVICE.items()], F.lit(""))
        rows.append(
            F.struct(
                F.lit(metric).alias("metric"),
                F.when(reason.isNull(), F.col(value)).alias("value"),
                F.when(reason.isNull(), F.col(severity)).alias("severity"),
                reason.isNull().alias("applicable"),
                F.coalesce(reason, F.concat(finding(metric), advice)).alias("note"),
            )
        )
    return suite_scope(metrics).select(*PAIR, F.inline(F.array(*rows)))


def stability_notes(stability: DataFrame) -> DataFrame:
    """D11 and D12 in words, beside their values."""
    index = F.when(F.col("fsi").isNull(), "No pair of versions has an index.").otherwise(
        F.concat(F.lit("Stable to "), _hundredths(F.col("fsi")), F.lit(" % over "), F.col("n_pairs").cast("string"), F.lit(" pairs."))
    )
    trend = (
        F.when(F.col("velocity").isNull(), "Two pairs are needed for a trend.")
        .when(F.col("velocity") > 0, F.concat(F.lit("Drift grows by "), _hundredths(F.col("velocity")), F.lit(" hundredths a version.")))
        .when(F.col("velocity") < 0, F.concat(F.lit("Drift falls by "), _hundredths(-F.col("velocity")), F.lit(" hundredths a version.")))
        .otherwise("Drift neither grows nor falls.")
    )
    return stability.withColumns({"fsi_note": index, "velocity_note": trend})


def suite_scope(df: DataFrame, base: str = "base", targets: bool = False) -> DataFrame:
    """Columns the drift suite covers: in the first version, not an id or constant, not a label."""
    scale = F.col(f"{base}.statistical_scale")
    out = df.where(F.col(base).isNotNull() & ~scale.isin(*vocab.SUITE_SKIP_SCALES))
    return out if targets else out.where(~is_target(F.col("column_name")))


def fsi_label(fsi: Column) -> Column:
    return (
        F.when(fsi.isNull(), "insufficient_data")
        .when(fsi >= vocab.FSI_STABLE, "stable")
        .when(fsi >= vocab.FSI_MONITOR, "monitor")
        .otherwise("unstable")
    )


def stability(metrics: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """D11 and D12 in one aggregation: stability index and drift velocity per column.

    The index has four digits, so sums are taken over whole ten-thousandths: exact in any order.
    """
    x, y = F.col("pair_idx").cast("bigint"), F.round(F.col("psi") * 10000).cast("bigint")
    have = F.when(y.isNotNull(), x)
    n, total = F.col("n_pairs"), F.col("s_y")
    fitted = slope(n.cast("double"), F.col("s_x").cast("double"), total.cast("double"), F.col("s_xy").cast("double"), F.col("s_xx").cast("double"))
    return (
        suite_scope(metrics)
        .groupBy(*COLUMN)
        .agg(
            F.count("psi").alias("n_pairs"),
            F.sum(have).alias("s_x"),
            F.sum(y).alias("s_y"),
            F.sum(have * y).alias("s_xy"),
            F.sum(have * have).alias("s_xx"),
        )
        .withColumns(
            {
                "mean_psi": F.round(F.try_divide(total, n)) / 10000,
                "fsi": F.greatest(F.lit(0.0), F.round(10000 - F.try_divide(total, n) / cfg.psi_monitor) / 10000),
                "velocity": F.when(n >= 2, F.round(fitted) / 10000),
            }
        )
        .withColumns(
            {
                "fsi": F.when(n > 0, F.col("fsi")),
                "velocity_label": F.coalesce(
                    three_way(F.abs("velocity"), *vocab.METRIC_LIMITS["drift_velocity"]), F.lit("insufficient_data")
                ),
            }
        )
        .withColumn("fsi_label", fsi_label(F.col("fsi")))
        .drop("s_x", "s_y", "s_xy", "s_xx")
    )


def worst_psi_label() -> Column:
    """Worst label among the pairs that have an index."""
    has = lambda l: F.bool_or(F.col("psi_applicable") & (F.col("psi_label") == l))
    return (
        F.when(has("shift"), "shift")
        .when(has("monitor"), "monitor")
        .when(F.bool_or("psi_applicable"), "stable")
        .otherwise("not_applicable")
    )


def baseline_pairs(first_pairs: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """D13 rows: index of each later version against the first one."""
    return P.with_union_psi(suite_scope(first_pairs, "a", targets=True), cfg).drop("a", "b", *P.SCRATCH)


def baseline_worst(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*COLUMN).agg(
        worst_psi_label().alias("worst_label"),
        F.max_by("psi", F.when(F.col("psi_applicable"), F.col("pair_idx"))).alias("last_psi"),
    )


def psi_buckets(pairs: DataFrame) -> DataFrame:
    """D8 buckets as rows."""
    return pairs.select(*COLUMN, "pair_idx", F.inline(P.union_buckets()))


def legacy_psi(pairs: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """Base-edge index per pair."""
    plain = pairs.select(*COLUMN, "pair_idx", "a", "b")
    return P.with_base_edge_psi(plain, cfg).select(*COLUMN, "pair_idx", "psi", "psi_label", "psi_applicable")
