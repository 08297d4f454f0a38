"""Threshold-scaled document fingerprints in SQL expressions only.

A fingerprint holds every hash of a run of five words that lies below a fixed fraction of the hash range.
Which hashes are kept does not depend on the length of the text, so fingerprints merge by union and tell how
much of a short text lies in a long one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varve.sources.shared import written

WORDS = 5
#: One hash in so many is kept.
SCALE = 8


#: Text of a range of ids that one task sorts.
BLOCK_BYTES = 64 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct hashes kept of a text; a text of 1 to 4 words has one run, one without words none."""
    limit = -(1 << 63) + (1 << 64) // scale
    split = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")

    def runs(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= words, each).otherwise(short)

    kept = F.filter(let(F.transform(split, lambda w: F.xxhash64(w)), runs), lambda x: x < F.lit(limit))
    return F.array_sort(F.array_distinct(kept))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of the smaller fingerprint that the other holds too; of two empty ones, whether the texts are the same."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), same.cast("double")).otherwise(F.when(least == 0, 0.0).otherwise(shared))


def merged(fingerprints: Column) -> Column:
    """The fingerprint of texts taken together, from a collected list of theirs."""
    return F.array_sort(F.array_distinct(F.flatten(fingerprints)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(fingerprint.cast("array<string>"), ",")


def counted_until(bounds: Column, marks: Column, stride: int, before: Callable[[Column], Column]) -> Column:
    """How many of the ascending bounds lie before a value: every stride-th first, then those between two of them."""
    passed = F.size(F.filter(marks, before)) * stride
    return passed + F.size(F.filter(F.slice(bounds, passed + 1, stride), before))


def placed(value: Column, within: Column, bounds: Column, marks: Column, stride: int) -> tuple[Column, Column]:
    """The range of a value between bounds, and its place in [0, 1) within the range among rows of equal value.

    A value that several bounds repeat holds several ranges; its rows are dealt to them by ``within``, in order.
    """
    low = counted_until(bounds, marks, stride, lambda b: b < value)
    high = counted_until(bounds, marks, stride, lambda b: b <= value)
    spot = within * (high - low + 1)
    return low + F.floor(spot).cast("int"), spot - F.floor(spot)


def in_order(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``tie`` and ``block``: ranges of (doc_id, tie) of about equal row counts and about ``block_bytes``.

    Two levels of quantiles (of all ids, then of each range) keep both lists of bounds short. An id that fills
    several ranges is split by ``tie``, the hash of the text, and so are the rows without an id, which come last.
    """
    spark = docs.sparkSession
    size = F.octet_length("text") + 16
    total = docs.agg(F.sum(size).alias("all"), F.sum(F.when(F.col("doc_id").isNull(), size)).alias("null")).first()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total["all"] or 0) / block_bytes))
    n = max(2, math.ceil(math.sqrt(wanted)))
    nulls, stride = max(1, math.ceil((total["null"] or 0) / block_bytes)), math.isqrt(n) + 1
    cuts = F.array(*[F.lit(k / n) for k in range(1, n)])
    bounds = lambda c: F.coalesce(F.percentile_approx(c, cuts, 10_000), F.array().cast("array<bigint>"))
    every = lambda b: F.filter(b, lambda _, i: i % stride == stride - 1)
    outer = F.array(*[F.lit(b) for b in docs.agg(bounds("doc_id").alias("b")).first()["b"]]).cast("array<bigint>")
    tied = docs.withColumn("tie", F.xxhash64("text"))
    fraction = (F.col("tie") / F.lit(2.0**64) + 0.5) * (1 - 2.0**-50)
    known = F.col("doc_id").isNotNull()
    low, within = placed(F.col("doc_id"), fraction, outer, every(outer), stride)
    ranged = tied.withColumns({"range": F.when(known, low).otherwise(n), "within": F.when(known, within).otherwise(fraction)})
    # one row for each of the n ranges and that of the null ids
    inner = ranged.groupBy("range").agg(bounds("doc_id").alias("inner")).withColumnRenamed("range", "of").withColumn("marks", every(F.col("inner")))
    joined = ranged.join(written(inner, "fingerprint-ranges"), F.col("range") == F.col("of"))
    at, _ = placed(F.col("doc_id"), F.col("within"), F.col("inner"), F.col("marks"), stride)
    block = F.when(known, F.col("range") * n + at).otherwise(n * n + F.floor(F.col("within") * nulls).cast("int"))
    return joined.withColumn("block", block).drop("range", "of", "inner", "marks", "within")


def with_next(docs: DataFrame, make: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """``make(docs)`` with next_<c> of each carried column: that of the next row by doc_id, of the last row the first's.

    Rows are sorted inside blocks of ids; the first row of each block is also sent to the block before it, so
    texts move once and no task sees more than one block.
    """
    spark = docs.sparkSession
    blocked = in_order(docs)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    per_block = blocked.groupBy("block").agg(F.min(place).alias("first"))
    around = W.orderBy("block")
    everything = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # one row per block
    heads = written(per_block.withColumn("before", F.coalesce(F.lag("block").over(around), F.max("block").over(everything))), "fingerprint-heads")
    heads = heads.select(F.col("block").alias("head"), "first", "before")
    tails = blocked.join(heads, (F.col("block") == F.col("head")) & place.eqNullSafe(F.col("first"))).dropDuplicates(["block"])
    tails = tails.withColumn("block", F.col("before")).drop("head", "first", "before")
    both = make(blocked).withColumn("tail", F.lit(0)).unionByName(make(tails).withColumn("tail", F.lit(1)))
    order = W.partitionBy("block").orderBy("tail", F.col("doc_id").asc_nulls_last(), "tie")
    out = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return out.where("tail = 0").drop("tail", "tie", "block")


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The text with its last floor(n/2) characters replaced by the first as many of the following one."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - half), F.substring(following, F.lit(1), half))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. Rows are ordered by doc_id, null ids last, equal ids by a hash of the text; the
    only row of a table is its own next. An empty table gives an empty result; other columns are ignored.
    Likeness is the share of the smaller fingerprint found in the other (containment).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ready = with_next(docs, lambda d: d.withColumn("print", fingerprint(F.col("text"))), ["text", "print"])
    ready = ready.withColumn("n_chars", F.char_length("text"))
    ready = ready.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    ready = ready.withColumn("edited_print", fingerprint(F.col("edited")))
    return ready.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), F.col("edited") == F.col("text")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print"), F.col("next_text") == F.col("text")).alias("near_next"),
    )
