"""Exact drift metrics from value counts, where quantile points only approximate them.

Each distinct value of a version feeds at most two version pairs. Counts are combined per value
before any ranking, and rank work runs in value ranges, never over a whole column at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve import vocab
from varve.config import Thresholds
from varve.functions.psi import FLOOR, divergence, psi_label
from varve.functions.scalars import three_way
from varve.operators.pairs import COLUMN
from varve.sources.shared import written

PAIR = [*COLUMN, "pair_idx"]
#: Ranges of a pair's values in which ranks are worked out apart.
RANGES = 128
STRIDE = 12


def _numbers(scale: str, skipped: list[str]) -> Column:
    return (F.col("a.data_type") == "num") & (F.col("b.data_type") == "num") & ~F.col(f"{scale}.statistical_scale").isin(*skipped)


def _categories() -> Column:
    return (F.col("a.data_type") == "char") & (F.col("b.data_type") == "char") & ~F.col("a.statistical_scale").isin("id", "unary")


def compared(pairs: DataFrame) -> DataFrame:
    """The version pairs whose values are compared one by one (D7x, D9x); ids and constants are not."""
    return pairs.where(_numbers("base", vocab.SUITE_SKIP_SCALES) | _categories()).select(*PAIR, "from_version", "to_version")


def _sides(scope: DataFrame) -> DataFrame:
    """Each pair once for either version, as a small written table that can be sent to the counts."""
    side = lambda name, column: F.struct(F.lit(name).alias("side"), F.col(column).alias("version"))
    kept = [c for c in scope.columns if c not in ("from_version", "to_version")]
    return written(scope.select(*kept, F.inline(F.array(side("a", "from_version"), side("b", "to_version")))), "pairs")


def pair_counts(counts: DataFrame, scope: DataFrame) -> DataFrame:
    """Counts of each value on both sides of the pairs in scope: (pair, value, ca, cb); a text travels as its digest."""
    at = lambda s: F.sum(F.when(F.col("side") == s, F.col("cnt")).otherwise(0))
    return (
        counts.where("num is not null or digest is not null")
        .join(_sides(scope), [*COLUMN, "version"])
        .groupBy(*PAIR, "num", "digest", "res")
        .agg(at("a").alias("ca"), at("b").alias("cb"))
    )


def entropy(counts: DataFrame) -> DataFrame:
    """D6x part: Shannon entropy of every version of a text or binary column."""
    c = F.col("cnt").cast("double")
    # H = log2 N - sum(c log2 c) / N needs one mergeable pass
    return (
        counts.where("num is not null or digest is not null")
        .groupBy(*COLUMN, "version")
        .agg(F.sum("cnt").alias("n"), F.sum(c * F.log2(c)).alias("weighted"))
        .withColumn("entropy", F.log2("n") - F.col("weighted") / F.col("n"))
        .select(*COLUMN, "version", "entropy")
    )


def entropy_drift(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """D6x: relative change of the exact entropy per pair."""
    h = entropy(counts)
    scope = pairs.where((F.col("a.data_type") == "char") | (F.col("a.statistical_scale") == "binary")).where("b is not null")
    change = F.when(F.col("entropy_base") >= 1e-9, F.abs(F.col("entropy_new") - F.col("entropy_base")) / F.col("entropy_base"))
    return (
        scope.select(*PAIR, "from_version", "to_version")
        .join(h.select(*COLUMN, F.col("version").alias("from_version"), F.col("entropy").alias("entropy_base")), [*COLUMN, "from_version"])
        .join(h.select(*COLUMN, F.col("version").alias("to_version"), F.col("entropy").alias("entropy_new")), [*COLUMN, "to_version"])
        .withColumn("entropy_change", change)
        .withColumn("severity", three_way(F.col("entropy_change"), *vocab.METRIC_LIMITS["entropy_drift"]))
        .drop("from_version", "to_version")
    )


def ranged(numbers: DataFrame) -> DataFrame:
    """Counts per pair, range and value; ranges hold about equal numbers of distinct values, however the values lie."""
    cuts = [k / RANGES for k in range(1, RANGES)]
    edges = numbers.groupBy(*PAIR).agg(F.percentile_approx("num", cuts, 20 * RANGES).alias("edges"))
    # every STRIDE-th edge first, then the edges between two of them
    marks = F.filter("edges", lambda e, i: i % STRIDE == STRIDE - 1)
    edges = written(edges.withColumn("marks", marks), "edges")
    below = lambda a: F.size(F.filter(a, lambda e: e < F.col("num")))
    passed = below("marks") * STRIDE
    return (
        numbers.join(edges, PAIR)
        .withColumn("passed", passed)
        .withColumn("range", F.col("passed") + below(F.slice("edges", F.col("passed") + 1, STRIDE)))
        .groupBy(*PAIR, "range", "num")
        .agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    )


def ks_exact(pc: DataFrame, pairs: DataFrame) -> DataFrame:
    """D7x: largest gap between the two empirical distribution functions of a pair."""
    scope = pairs.where(_numbers("base", vocab.SUITE_SKIP_SCALES)).select(*PAIR)
    numbers = pc.where("num is not null").join(written(scope, "pairs"), PAIR, "left_semi")
    counted = ranged(numbers)
    whole = Window.partitionBy(*PAIR)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range of a pair
    totals = written(
        counted.groupBy(*PAIR, "range")
        .agg(F.sum("ca").alias("ra"), F.sum("cb").alias("rb"))
        .select(
            *PAIR,
            "range",
            F.coalesce(F.sum("ra").over(before), F.lit(0)).alias("before_a"),
            F.coalesce(F.sum("rb").over(before), F.lit(0)).alias("before_b"),
            F.sum("ra").over(whole).alias("na"),
            F.sum("rb").over(whole).alias("nb"),
        ),
        "ranges",
    )
    inside = Window.partitionBy(*PAIR, "range").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(
        F.try_divide(F.col("before_a") + F.sum("ca").over(inside), F.col("na"))
        - F.try_divide(F.col("before_b") + F.sum("cb").over(inside), F.col("nb"))
    )
    return (
        counted.join(totals, [*PAIR, "range"])
        .where("na > 0 and nb > 0")
        .withColumn("gap", gap)
        .groupBy(*PAIR)
        .agg(F.max("gap").alias("ks"))
        .withColumn("severity", three_way(F.col("ks"), *vocab.METRIC_LIMITS["ks_approx"]))
    )


def psi_exact(counts: DataFrame, pairs: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """D8x: index over the exact quartile bins of the earlier version; bins are counted where the value counts lie."""
    scope = pairs.where(_numbers("a", vocab.NON_DISTRIBUTION_SCALES) & F.col("a.q50").isNotNull() & F.col("b.q50").isNotNull())
    edges = _sides(scope.select(*PAIR, "a.q25", "a.q50", "a.q75", "from_version", "to_version"))
    bin_no = F.when(F.col("num") <= F.col("q25"), 0).when(F.col("num") <= F.col("q50"), 1).when(F.col("num") <= F.col("q75"), 2).otherwise(3)
    side = lambda s, i: F.sum(F.when((F.col("side") == s) & (F.col("bin") == i), F.col("cnt")).otherwise(0)).alias(f"c{s}{i}")
    counted = (
        counts.where("num is not null")
        .join(edges, [*COLUMN, "version"])
        .withColumn("bin", bin_no)
        .groupBy(*PAIR)
        .agg(*[side(s, i) for s in ("a", "b") for i in range(4)])
    )
    total = lambda s: sum((F.col(f"{s}{i}") for i in range(1, 4)), F.col(f"{s}0"))
    shares = {
        f"p{s}{i}": F.greatest(F.try_divide(F.col(f"{s}{i}"), total(s)), F.lit(FLOOR)) for s in ("ca", "cb") for i in range(4)
    }
    terms = [divergence(F.col(f"pca{i}"), F.col(f"pcb{i}")) for i in range(4)]
    return (
        counted.withColumns(shares)
        .withColumn("psi", terms[0] + terms[1] + terms[2] + terms[3])
        .withColumn("psi_label", psi_label(F.col("psi"), cfg))
        .select(*PAIR, "psi", "psi_label")
    )


def psi_exact_bins(counts: DataFrame, pairs: DataFrame, quantiles: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """D8x over any number of bins: cut at the earlier version's exact ``quantiles`` (table, version, column, quantiles).

    A value that equals a cut belongs to the bin below it; equal cuts leave bins empty, which count as the floor on
    both sides. The bin is the number of cuts below a value, looked up in the short list of its pair.
    """
    scope = pairs.where(_numbers("a", vocab.NON_DISTRIBUTION_SCALES) & F.col("a.q50").isNotNull() & F.col("b.q50").isNotNull())
    cuts = quantiles.select(*COLUMN, F.col("version").alias("from_version"), F.col("quantiles").alias("cuts"))
    edges = _sides(scope.select(*PAIR, "from_version", "to_version").join(cuts, [*COLUMN, "from_version"]))
    counted = (
        counts.where("num is not null")
        .join(edges, [*COLUMN, "version"])
        .withColumn("bin", F.size(F.filter("cuts", lambda e: e < F.col("num"))))
        .groupBy(*PAIR, "bin", F.size("cuts").alias("cuts"))
        .agg(*[F.sum(F.when(F.col("side") == s, F.col("cnt")).otherwise(0)).alias(f"c{s}") for s in ("a", "b")])
    )
    # one row per pair and bin that holds anything; empty bins differ by nothing
    totals = counted.groupBy(*PAIR).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    share = lambda c, n: F.greatest(F.try_divide(F.col(c), F.col(n)), F.lit(FLOOR))
    return (
        counted.join(totals, PAIR)
        .groupBy(*PAIR)
        .agg(F.sum(divergence(share("ca", "na"), share("cb", "nb"))).alias("psi"), F.max("cuts").alias("cuts"))
        .withColumn("psi_label", psi_label(F.col("psi"), cfg))
        .select(*PAIR, (F.col("cuts") + 1).alias("bins"), "psi", "psi_label")
    )


def psi_categorical_exact(pc: DataFrame, pairs: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """D9x: index over the shares of every category, new and lost ones included.

    A category missing on one side counts as half a row there, or as the usual floor where that is less;
    present categories keep their share, however many there are.
    """
    scoped = pc.where("digest is not null").join(written(pairs.where(_categories()).select(*PAIR), "pairs"), PAIR, "left_semi")
    totals = written(scoped.groupBy(*PAIR).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb")), "totals")
    share = lambda c, n: F.when(F.col(c) > 0, F.col(c) / F.col(n)).otherwise(F.least(F.lit(FLOOR), 0.5 / F.col(n)))
    return (
        scoped.join(totals, PAIR)
        .where("na > 0 and nb > 0")
        .groupBy(*PAIR)
        .agg(
            F.sum(divergence(share("ca", "na"), share("cb", "nb"))).alias("psi"),
            F.count(F.lit(1)).alias("categories"),
        )
        .withColumn("psi_label", psi_label(F.col("psi"), cfg))
    )
