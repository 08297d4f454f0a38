"""Profiles that grow by parts: one small mergeable state per table, version, column and part of the input.

A part is whatever arrives together (a file, a day, a load). Its rows are read once and leave a row of counts, central
moments and sketches per column; a profile is the merge of the stored states, so a new part never has old rows read
again, and a part that is loaded twice replaces itself. A state is a few kilobytes whatever the part holds.

Counts, limits, mean, spread, skewness and kurtosis merge exactly (up to rounding). Distinct values, quartiles,
outliers and the mode are estimates: HLL (about 2 % standard error), KLL (about 1.3 % of rank), outliers as the ranks
outside the estimated fences, the mode as the most frequent item of the merged summaries, given if it is held by more
than FREQUENT of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.sources.rows import FREQUENT, KEYS, NO_VERSION, TRACKED, TableSpec, finished, melt_all, shown, versioned

#: Characters of a text as an item of the frequent-value summary; longer ones end in their digest.
ITEM = 64
#: Quantiles by which the share of outliers is read: a step of half a percent.
POINTS = 200


def _item() -> Column:
    long = F.concat(F.left("txt", F.lit(ITEM - 33)), F.lit("~"), F.md5("txt"))
    return F.coalesce(F.when(F.length("txt") <= ITEM, F.col("txt")).otherwise(long), F.col("num").cast("string"))


def partial_states(specs: list[TableSpec], part: str) -> DataFrame:
    """The states of the rows of ``specs``, by the part named in their column ``part``. One scan, combined before the shuffle."""
    long = versioned(melt_all(specs, part)).withColumn("num", F.col("num") + F.lit(0.0))
    long = long.withColumns({"h": F.when(F.col("num").isNotNull() | F.col("txt").isNotNull(), F.xxhash64("num", "txt", "res")), "item": _item()})
    n = F.count("num")
    m2 = F.coalesce(F.var_pop("num") * n, F.lit(0.0))
    shape = lambda x, of: F.when(m2 > 0, x * of).otherwise(0.0)
    return long.groupBy(*KEYS, "part").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("has").alias("n_present"),
        n.alias("n_num"),
        F.min("num").alias("min_val"),
        F.max("num").alias("max_val"),
        F.coalesce(F.avg("num"), F.lit(0.0)).alias("mean"),
        m2.alias("m2"),
        shape(F.skewness("num"), F.pow(m2, 1.5) / F.sqrt(n)).alias("m3"),
        shape(F.kurtosis("num") + 3.0, m2 * m2 / n).alias("m4"),
        F.count_if("blank").alias("n_blank"),
        F.count_if("miss").alias("n_miss"),
        F.max(F.length("txt")).alias("len_max"),
        F.min(F.length("txt")).alias("len_min"),
        F.hll_sketch_agg("h").alias("distinct_sketch"),
        F.kll_sketch_agg_double("num").alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(item, {TRACKED}) FILTER (WHERE item IS NOT NULL)").alias("frequent_sketch"),
    )


def write_states(states: DataFrame, path: str) -> None:
    """Add the states of new parts to a store; a part of a table that is there already is replaced as a whole."""
    (
        states.repartition("table_name", "part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("table_name", "part")
        .parquet(path)
    )


def merged(states: DataFrame) -> DataFrame:
    """Facts of every (table, version, column) over all its parts."""
    whole = states.groupBy(*KEYS).agg(F.try_divide(F.sum(F.col("n_num") * F.col("mean")), F.sum("n_num")).alias("whole_mean"))
    n, d, m2, m3, m4 = F.col("n_num"), F.col("mean") - F.col("whole_mean"), F.col("m2"), F.col("m3"), F.col("m4")
    facts = (
        states.join(whole, KEYS)
        .groupBy(*KEYS)
        .agg(
            F.sum("row_count").alias("row_count"),
            F.sum("n_present").alias("n_present"),
            F.sum("n_num").alias("n"),
            F.min("min_val").alias("min_val"),
            F.max("max_val").alias("max_val"),
            F.max("whole_mean").alias("mean"),
            # moments about the common mean
            F.sum(F.when(n > 0, m2 + n * d * d)).alias("m2"),
            F.sum(F.when(n > 0, m3 + 3 * d * m2 + n * d * d * d)).alias("m3"),
            F.sum(F.when(n > 0, m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d)).alias("m4"),
            F.sum("n_blank").alias("blank_value_count"),
            F.sum("n_miss").alias("mismatched_count"),
            F.max("len_max").alias("chars_max_count"),
            F.min("len_min").alias("chars_min_count"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("cardinality_count"),
            F.kll_merge_agg_double("quantile_sketch").alias("quantiles"),
            F.expr("approx_top_k_estimate(approx_top_k_combine(frequent_sketch), 1)").alias("top"),
        )
    )
    n, m2 = F.col("n").cast("double"), F.col("m2")
    quantile = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    facts = facts.withColumns({name: quantile(p) for name, p in [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]})
    fence = 1.5 * (F.col("q75") - F.col("q25"))
    # the ranks outside the fences, read off evenly spaced quantiles
    points = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])))
    low, high = F.col("q25") - fence, F.col("q75") + fence
    outside = F.size(F.filter(points, lambda v: (v < low) | (v > high))) / POINTS
    top = F.get("top", F.lit(0))
    return facts.withColumns(
        {
            "std": F.when(n > 1, F.sqrt(m2 / (n - 1))),
            "skewness": F.when(m2 > 0, F.sqrt(n) * F.col("m3") / (m2 * F.sqrt(m2))),
            "kurtosis": F.when(m2 > 0, n * F.col("m4") / (m2 * m2) - 3.0),
            "n_outliers": F.when(F.col("n") > 0, F.round(outside * n).cast("bigint")),
            "most_common_value": F.when(top["count"] > FREQUENT * F.col("row_count"), top["item"]),
            "least_common_value": F.lit(None).cast("string"),
        }
    ).drop("quantiles", "top", "n", "m2", "m3", "m4")


def profile_of_states(spark: SparkSession, states: DataFrame, specs: list[TableSpec], overrides: DataFrame | None = None, snapshot_date: str | None = None) -> DataFrame:
    """A profile, with the columns of ``rows.profile``, from stored states alone; ``specs`` give the schema, no rows are read."""
    return finished(spark, shown(merged(states)), specs, overrides, snapshot_date)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("version", F.coalesce("version", F.lit(NO_VERSION)))
