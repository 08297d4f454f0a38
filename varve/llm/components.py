"""Connected components of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join, so a node with a third of all links
costs no task more than its share; no list of neighbours is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.sources.shared import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b), both bigint; label is the smallest node reachable.

    Loops and repeated links do no harm; nodes without links are not listed; no links give no rows. The loop
    ends when a round changes nothing, after about log(n) rounds; each round is a written table.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("m").alias("a"), "b").distinct()
        lowest = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(lowest, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        old, edges = edges, written(small.where("a <> b").distinct(), "links")
        discard(old)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)
