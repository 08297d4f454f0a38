"""Mixing sources to target weights: repetition rates per source, then whole copies plus one seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varve.llm.columns import unused
from varve.sources.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in order, over and over.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: source_size, target, rate.

    The budget is ``share`` of all words, dealt by weight; no target exceeds ``most`` times its source. Filling
    the sources in order of size per weight gives at once what resharing the excess again and again ends in:
    the sources before some point are full, those after it get what is left by weight; the level of the first
    that is not full is the highest. One row per source enters the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.col("budget") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        per.withColumn("weight", weight)
        .withColumn("budget", share * F.sum("source_size").over(whole))
        .withColumn("level", level)
        .withColumn("full", most * F.col("source_size") <= F.col("level") * F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
        .select(
            "source",
            "source_size",
            F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
        )
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    )


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 48 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate) copies and one more with the probability of the fraction."""
    return (F.floor(rate) + F.when(draw(key, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_counts(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken (size times its copies in the mix).

    Null or empty texts have size 0 and take nothing; a null source is a source of its own, ordered last.
    Rows that repeat a doc_id share its draw, a null doc_id counts as one id. Every source of an empty total
    has target 0. No source is gathered: only its sum travels, and each document draws alone.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sizes = written(sizes, "mix-sizes")  # words are counted once
    plan = written(rates(sizes, **options).withColumnRenamed("source", "of"), "mix-rates")
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"), seed)).alias("taken")
    )


def mix_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Same rules as mix_counts; a document of size 0 is kept as often as its source's rate says.
    """
    sizes = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    of, rate, copy = (unused(docs.columns, f"mix_{n}") for n in ("of", "rate", "copy"))
    plan = written(rates(sizes, **options).select(F.col("source").alias(of), F.col("rate").alias(rate)), "mix-rates")
    n = copies(F.col(rate), F.col("doc_id"), seed)
    return (
        docs.join(plan, F.col("source").cast("string").eqNullSafe(F.col(of)))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))))
        .where(F.col(copy) <= n)
        .drop(copy, of, rate)
    )


#: The same rows in DuckDB; sources are ordered by code point in both.
MIX_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight FROM per),
filled AS (
  SELECT *, (1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
capped AS (SELECT *, 2 * source_size <= level * weight AS is_full FROM filled),
plan AS (
  SELECT source AS src, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE weight * max(CASE WHEN NOT is_full THEN level END) OVER () END AS target FROM capped),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM plan)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes JOIN rated ON sizes.source IS NOT DISTINCT FROM rated.src
"""
