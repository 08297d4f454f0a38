"""Stability index and friends over rows that hold two column profiles, ``a`` and ``b``.

Each step adds named columns, so that shared terms are computed once and the generated code stays
small; expressions nested into one another would be copied at every use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.config import Thresholds
from varve.functions.scalars import safe
from varve.vocab import NON_DISTRIBUTION_SCALES

FLOOR = 1e-6
POINTS = ["min_val", "q25", "q50", "q75", "max_val"]
QUARTILE_CDF = [0.0, 0.25, 0.50, 0.75, 1.0]
BUCKETS = ["≤Q1", "Q1–Median", "Median–Q3", "Q3–Max"]


def points(side: str) -> list[Column]:
    return [F.col(f"{side}.{p}") for p in POINTS]


def have_points(side: str) -> Column:
    known = F.lit(True)
    for p in points(side):
        known = known & p.isNotNull()
    return known


def cdf_at(x: Column, pts: list[Column]) -> Column:
    """Piecewise-linear distribution function through the five points."""
    expr = F.when(x <= pts[0], 0.0).when(x >= pts[-1], 1.0)
    for lo, hi, p, q in zip(pts, pts[1:], QUARTILE_CDF, QUARTILE_CDF[1:]):
        width = hi - lo
        expr = expr.when(
            (x >= lo) & (x <= hi), F.when(F.abs(width) < 1e-9, p).otherwise(p + (x - lo) / width * (q - p))
        )
    return expr.otherwise(1.0)


def divergence(base: Column, new: Column) -> Column:
    return (new - base) * F.ln(new / base)


def psi_label(psi: Column, cfg: Thresholds) -> Column:
    return F.when(psi < cfg.psi_stable, "stable").when(psi < cfg.psi_monitor, "monitor").when(psi.isNotNull(), "shift")


def both_present() -> Column:
    return F.col("a").isNotNull() & F.col("b").isNotNull()


def both_numeric() -> Column:
    return (F.col("a.data_type") == "num") & (F.col("b.data_type") == "num")


def normalised(df: DataFrame, parts: list[str], out: list[str]) -> DataFrame:
    """Shares of the total, floored; equal shares when there is nothing to divide."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    share = lambda p: F.greatest(
        F.when(F.col("_total") <= 0, 1.0 / len(parts)).otherwise(F.try_divide(F.col(p), F.col("_total"))), F.lit(FLOOR)
    )
    return df.withColumn("_total", total).withColumns({o: share(p) for p, o in zip(parts, out)}).drop("_total")


def with_categorical_proxy(df: DataFrame) -> DataFrame:
    """D9 column ``proxy``: index of non-numeric columns from cardinality and completeness alone."""
    out = df
    for s in "ab":
        top = 1.0 / F.greatest(F.col(f"{s}.cardinality_count"), F.lit(1))
        full = F.col(f"{s}.completeness_percent") / 100.0
        out = out.withColumns({f"_{s}0": full * top, f"_{s}1": full * (1 - top)})
        out = normalised(out, [f"_{s}0", f"_{s}1"], [f"_{s}2", f"_{s}3"])
    ca, cb = F.col("a.cardinality_count"), F.col("b.cardinality_count")
    same = divergence(F.col("_a2"), F.col("_b2")) + divergence(F.col("_a3"), F.col("_b3"))
    out = out.withColumn("proxy", F.when(ca != cb, F.least(F.abs(cb - ca) * 0.15, F.lit(1.0))).otherwise(same))
    return out.drop(*[f"_{s}{i}" for s in "ab" for i in range(4)])


def with_union_shares(df: DataFrame) -> DataFrame:
    """Columns base_share_0..3 and new_share_0..3 over edges shared by both sides, and new_cdf_1..3."""
    low = F.least(F.coalesce("a.min_val", "a.q25"), F.coalesce("b.min_val", "b.q25"))
    high = F.greatest(F.coalesce("a.max_val", "a.q75"), F.coalesce("b.max_val", "b.q75"))
    out = df.withColumns({"_e0": low, "_e4": high})
    edges = [F.col("_e0"), F.col("a.q25"), F.col("a.q50"), F.col("a.q75"), F.col("_e4")]
    for s, name in [("a", "base"), ("b", "new")]:
        full = F.coalesce(F.col(f"{s}.completeness_percent"), F.lit(100.0)) / 100.0
        out = out.withColumns({f"{name}_cdf_{i}": cdf_at(e, points(s)) for i, e in enumerate(edges)})
        mass = [
            F.when(have_points(s), F.greatest(F.lit(0.0), F.col(f"{name}_cdf_{i + 1}") - F.col(f"{name}_cdf_{i}")))
            .otherwise(0.25)
            * full
            for i in range(4)
        ]
        out = out.withColumns({f"_m{i}": m for i, m in enumerate(mass)})
        out = normalised(out, [f"_m{i}" for i in range(4)], [f"{name}_share_{i}" for i in range(4)])
    extra = [f"base_cdf_{i}" for i in range(5)] + ["new_cdf_0", "new_cdf_4"]
    return out.drop("_e0", "_e4", *[f"_m{i}" for i in range(4)], *extra)


SHARES = [f"{side}_share_{i}" for side in ("base", "new") for i in range(4)]
SCRATCH = [*SHARES, *[f"new_cdf_{i}" for i in (1, 2, 3)]]


def with_union_psi(df: DataFrame, cfg: Thresholds) -> DataFrame:
    """psi_raw, psi, psi_label, psi_applicable, and the shares behind them."""
    status = (
        F.when(~both_present(), "absent")
        .when(~both_numeric(), "proxy")
        .when(F.col("a.statistical_scale").isin(*NON_DISTRIBUTION_SCALES), "not_applicable")
        .when(F.col("a.q25").isNull() | F.col("a.q50").isNull() | F.col("a.q75").isNull(), "insufficient_data")
        .otherwise("numeric")
    )
    terms = [divergence(F.col(f"base_share_{i}"), F.col(f"new_share_{i}")) for i in range(4)]
    raw = F.when(F.col("psi_state") == "numeric", terms[0] + terms[1] + terms[2] + terms[3]).when(
        F.col("psi_state") == "proxy", F.col("proxy")
    )
    return (
        with_categorical_proxy(with_union_shares(df.withColumn("psi_state", status)))
        .withColumn("psi_raw", raw)
        .withColumns(
            {
                "psi": F.round("psi_raw", 4),
                "psi_label": F.coalesce(psi_label(F.col("psi_raw"), cfg), F.col("psi_state")),
                "psi_applicable": F.col("psi_raw").isNotNull(),
            }
        )
        .drop("proxy")
    )


def union_buckets() -> Column:
    """The four buckets of D8 as an array of structs, NULL where D8 has none."""
    rows = [
        F.struct(
            F.lit(i).alias("bucket_no"),
            F.lit(name).alias("bucket"),
            F.col(f"base_share_{i}").alias("base_share"),
            F.col(f"new_share_{i}").alias("new_share"),
            divergence(F.col(f"base_share_{i}"), F.col(f"new_share_{i}")).alias("contrib"),
        )
        for i, name in enumerate(BUCKETS)
    ]
    return F.when(F.col("psi_state") == "numeric", F.array(*rows))


def with_base_edge_psi(df: DataFrame, cfg: Thresholds) -> DataFrame:
    """Older variant with the base edges and one bucket for values out of range."""
    a, b = points("a"), points("b")
    quartiles_known = (
        F.col("b.q25").isNotNull() & F.col("b.q50").isNotNull() & F.col("b.q75").isNotNull() & F.col("b.max_val").isNotNull()
    )
    width = F.greatest(b[4] - b[0], F.lit(1e-9))
    ratio = F.col("b.completeness_percent") / 100.0 / F.greatest(F.col("a.completeness_percent") / 100.0, F.lit(1e-9))
    status = (
        F.when(~both_present(), "absent")
        .when(F.col("a.data_type") != F.col("b.data_type"), "type_changed")
        .when(
            (F.col("a.data_type") == "num") & ~F.col("a.statistical_scale").isin(*NON_DISTRIBUTION_SCALES),
            F.when(have_points("a"), "numeric").otherwise("insufficient_data"),
        )
        .when((F.col("a.data_type") == "char") & F.col("a.statistical_scale").isin("binary", "nominal"), "proxy")
        .otherwise("not_applicable")
    )
    out = df.withColumns({"_state": status, "_w": width, "_known": quartiles_known, "_ratio": ratio})
    w = F.col("_w")
    overlap = [
        F.greatest(F.lit(0.0), (F.least(hi, b[4]) - F.greatest(lo, b[0])) / w * 0.25) for lo, hi in zip(a, a[1:])
    ]
    outside = (F.greatest(b[4] - a[4], F.lit(0.0)) + F.greatest(a[0] - b[0], F.lit(0.0))) / w
    parts = [
        F.when(F.col("_known"), p).otherwise(d) * F.col("_ratio")
        for p, d in zip([*overlap, outside], [0.25, 0.25, 0.25, 0.25, 0.0])
    ]
    out = out.withColumns({f"_n{i}": p for i, p in enumerate(parts)})
    out = with_categorical_proxy(normalised(out, [f"_n{i}" for i in range(5)], [f"_s{i}" for i in range(5)]))
    terms = [divergence(F.lit(x), F.col(f"_s{i}")) for i, x in enumerate([0.25, 0.25, 0.25, 0.25, FLOOR])]
    raw = F.when(F.col("_state") == "numeric", terms[0] + terms[1] + terms[2] + terms[3] + terms[4]).when(
        F.col("_state") == "proxy", F.col("proxy")
    )
    return out.withColumn("_raw", raw).withColumns(
        {
            "psi": F.round("_raw", 4),
            "psi_label": F.coalesce(psi_label(F.col("_raw"), cfg), F.col("_state")),
            "psi_applicable": F.col("_raw").isNotNull(),
        }
    )


def with_entropy(df: DataFrame) -> DataFrame:
    """D6 columns: entropy from cardinality and uniqueness (one dominant value, the rest even)."""
    out = df
    for s, name in [("a", "entropy_base"), ("b", "entropy_new")]:
        card = F.col(f"{s}.cardinality_count")
        top = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - safe(F.col(f"{s}.uniqueness_percent")) / 100.0))
        out = out.withColumn("_top", top).withColumn("_rest", (1.0 - F.col("_top")) / F.greatest(card - 1, F.lit(1)))
        h = F.when(F.col("_top") > 1e-9, -F.col("_top") * F.log2("_top")).otherwise(0.0) - F.when(
            F.col("_rest") > 1e-9, (card - 1) * F.col("_rest") * F.log2("_rest")
        ).otherwise(0.0)
        out = out.withColumn(name, F.when(card <= 1, 0.0).otherwise(F.greatest(h, F.lit(0.0))))
    usable = (
        ~((F.col("a.data_type") == "num") & (F.col("a.statistical_scale") != "binary"))
        & (F.col("a.cardinality_count") > 0)
        & (F.col("b.cardinality_count") > 0)
        & (F.col("entropy_base") >= 1e-9)
    )
    return (
        out.withColumn("_ok", usable)
        .withColumns({n: F.when(F.col("_ok"), F.col(n)) for n in ("entropy_base", "entropy_new")})
        .withColumn("entropy_change", F.abs(F.col("entropy_new") - F.col("entropy_base")) / F.col("entropy_base"))
        .drop("_top", "_rest", "_ok")
    )


def with_ks(df: DataFrame) -> DataFrame:
    """D7 columns: largest gap of the two distribution functions at the five base points."""
    ok = both_numeric() & have_points("a") & have_points("b")
    at = [cdf_at(F.col("a.min_val"), points("b")), *[F.col(f"new_cdf_{i}") for i in (1, 2, 3)], cdf_at(F.col("a.max_val"), points("b"))]
    names = ["min", "Q1", "Median", "Q3", "max"]
    return (
        df.withColumns({f"_k{i}": F.when(ok, F.abs(c - p)) for i, (c, p) in enumerate(zip(at, QUARTILE_CDF))})
        .withColumn("ks", F.greatest(*[F.col(f"_k{i}") for i in range(5)]))
        .withColumn("ks_point", F.coalesce(*[F.when(F.col(f"_k{i}") == F.col("ks"), n) for i, n in enumerate(names)]))
        .drop(*[f"_k{i}" for i in range(5)])
    )
