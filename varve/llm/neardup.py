"""Near-duplicate groups by bottom-k sketches of one hash function.

A document is the set of its word shingles; equal sets are one class from the start. A class keeps the ``k``
smallest shingle hashes. Inverted lists of retained values give candidate pairs, the sketch of their union
estimates the likeness, and survivors are verified on the full sets.

Which of its retained values lead a class into a list: a set of n elements with J >= t to another shares at least
t*n of them, so under any one order of all values its first n - ceil(t*n) + 1 elements hold one in common; when
both sets fit in a sketch, the place of a common value bounds the overlap further. For longer sets the same holds
for the sketches with ``kept`` of k values, five standard deviations below the expected k*t. The order puts values
that are frequent in a sample of the classes last, by their count there, and the others by their hash: it costs
one bounded broadcast, and only the leading part of a sketch is ever shuffled.

Pairs are taken in two rounds. Each list first links its members to the one that holds its value at the
earliest place, which is the plainest of a group of copies; after these links are verified and joined to
components, only members of different components meet. In short lists they do so at once, which is linear in
the number of members. Long lists are first cut by size, as sets of very different sizes cannot be alike; the members
of those that stay long are looked up anew by their whole sets: their lists then follow from all shingles, rarest first
by exact counts, and the places bound the overlap without the slack of a sketch. So a large group of copies costs a few links per member, and no link between different texts is lost.
Each step's tables are deleted when the next step has been written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.columns import unused
from varve.llm.components import components
from varve.llm.idfilter import bits_of, split
from varve.llm.ship import ship
from varve.llm.textbytes import mix, shingle_hashes, slabs, word_hashes, words
from varve.sources.shared import bucketed, discard, written

K = 192
#: One class in HOT_SAMPLE is looked at for frequent values: those in HOT_SHARE of them, and in HOT_LEAST at least.
#: Shares add up to k, so there are at most k / HOT_SHARE frequent values, under a million, whatever the input.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST = 16, 0.0002, 3
#: Members without a list's commonest label that meet all others directly; lists with more are resolved by whole sets.
FEW = 64
#: Values of a sketch that a first look compares, and the standard deviations it allows.
GLANCE, GLANCE_DEVIATIONS = 48, 6
WHOLE = 1 << 40


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text in ascending order."""
    for slab in slabs(texts):
        w = words(slab)
        hashes, bounds = shingle_hashes(word_hashes(w), w.bounds, size)
        for i in range(slab.rows):
            # one bit less, so that Spark's signed order is the order of the hashes
            yield np.unique(hashes[bounds[i] : bounds[i + 1]] >> np.uint64(1))


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, dtype=np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketches(docs: DataFrame, size: int, k: int = K) -> DataFrame:
    """doc_id, n (distinct shingles), class, sketch (the k smallest hashes); without words n is 0 and class null."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, low = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                low.append(s[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), lists_of(low)], names=["doc_id", "n", "class", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, class long, sketch array<long>")


def full_sets(docs: DataFrame, size: int, bits: Broadcast) -> DataFrame:
    """class, set of the documents (doc_id, text) whose id has its bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(1), size) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), lists_of(sets)], names=["class", "set"])

    return split(docs, F.col("doc_id"), bits, True, run, "class long, set array<long>")


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without rows whose class (the first column) one task has told before."""
    told: set[int] = set()
    for batch in batches:
        fresh = [i for i, c in enumerate(batch.column(0).to_pylist()) if not (c in told or told.add(c))]
        yield batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int64()))


def frequent_values(table: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent values in ascending order and their counts among the sampled classes."""
    sampled = table.where((F.col("n") > 0) & (F.pmod(F.xxhash64("class"), F.lit(HOT_SAMPLE)) == 0)).select("class", F.explode("sketch").alias("value")).distinct()
    classes = sampled.agg(F.count_distinct("class")).first()[0]
    found = sampled.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= max(HOT_LEAST, HOT_SHARE * classes)).toArrow()
    order = np.argsort(values := found.column("value").to_numpy())
    return values[order], found.column("times").to_numpy()[order]


def leading(table: DataFrame, t: float, k: int = K) -> DataFrame:
    """value, class, n, place: the inverted lists of the leading values; place counts from 1 in the order of values."""
    spark = table.sparkSession
    kept = math.floor(k * t - 5 * math.sqrt(k * t * (1 - t)))
    hot = spark.sparkContext.broadcast(frequent_values(table, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times = hot.value
        for batch in once(batches):
            n = batch.column(1).to_numpy()
            lists = batch.column(2)
            held = np.diff(np.asarray(lists.offsets))
            value = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), held)
            at = np.minimum(np.searchsorted(values, value), max(len(values) - 1, 0))
            count = np.where(values[at] == value, times[at], 0) if len(values) else np.zeros(len(value), dtype=np.int64)
            order = np.lexsort((value, count, row))
            value, place = value[order], np.arange(len(value)) - np.repeat(np.cumsum(held) - held, held) + 1
            shared = np.minimum(np.ceil(t * n - 1e-9).astype(np.int64), kept)
            keep = place <= (np.minimum(n, k) - shared + 1)[row]
            row = row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(value[keep]), batch.column(0).take(pa.array(row)), pa.array(n[row]), pa.array(place[keep].astype(np.int32))], names=["value", "class", "n", "place"])

    lists = table.where("n > 0").select("class", "n", "sketch").mapInArrow(run, "value long, class long, n long, place int")
    return lists.repartition(parts(spark), "value").dropDuplicates(["value", "class"])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_value(lists: DataFrame, name: str) -> DataFrame:
    """Lists written in buckets of their values, so that grouping and joining them by value moves nothing."""
    return bucketed(lists, name, "value", parts(lists.sparkSession))


def prefixes(sets: DataFrame, t: float) -> DataFrame:
    """value, class, n, place: the inverted lists of whole sets (class, n, set), rarest values first by exact counts."""
    members = sets.select("class", "n", F.explode("set").alias("value"))
    shared = members.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("value"))).where("df > 1")
    per_class = shared.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    # values of one class alone come first; they are not listed
    until = F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1
    first = F.col("n") - F.size("common")
    listed = per_class.select("class", "n", until.alias("until"), first.alias("first"), F.posexplode("common").alias("at", "entry"))
    return listed.where(F.col("first") + F.col("at") + 1 <= F.col("until")).select(F.col("entry.value").alias("value"), "class", "n", (F.col("first") + F.col("at") + 1).cast("int").alias("place"))


def may_match(a: dict[str, Column], b: dict[str, Column], t: float, k: int = K) -> Column:
    """Sizes allow the likeness, and so do the places of the common value where both sets are known whole."""
    sizes = F.least(a["n"], b["n"]) >= F.lit(t) * F.greatest(a["n"], b["n"]) - 1e-9
    overlap = F.ceil(F.lit(t / (1 + t)) * (a["n"] + b["n"]) - 1e-9)
    places = (a["place"] <= a["n"] - overlap + 1) & (b["place"] <= b["n"] - overlap + 1)
    return sizes & ((F.greatest(a["n"], b["n"]) > k) | places)


def star_pairs(lists: DataFrame, t: float, k: int = K) -> DataFrame:
    """Each member of a list with the one that holds the value at the earliest place."""
    head = lists.groupBy("value").agg(F.min(F.struct("place", "class", "n")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    of = lambda s: {c: F.col(f"{s}{c}") for c in ("n", "place")}
    found = lists.join(head, "value").where(F.col("head.class") != F.col("class")).where(may_match(of("head."), of(""), t, k))
    return found.select(F.least("head.class", "class").alias("a"), F.greatest("head.class", "class").alias("b")).distinct()


def open_lists(marked: DataFrame) -> DataFrame:
    """value, most, few, members: the lists whose members have several labels; the commonest label and how many have another."""
    per = marked.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c"))
    lists = per.groupBy("value").agg(F.max_by("label", "c").alias("most"), F.sum("c").alias("members"), F.max("c").alias("top"))
    return lists.where("members > top").select("value", "most", (F.col("members") - F.col("top")).alias("few"), "members")


def bands(marked: DataFrame, t: float) -> DataFrame:
    """Lists cut by the sizes of their sets: sets that may be alike are in one band or in neighbouring ones.

    A member is in the list of its own band, and as a guest (``own`` false) in that of the band below.
    """
    # a little wider than the ratio t, so that rounding puts no two that may be alike further apart
    band = F.floor(F.log("n") / max(-math.log(t) * (1 + 1e-6), 1e-9))
    entry = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own"))))
    rows = marked.select("value", "class", "n", "place", "label", entry.alias("entry"))
    # lists that get one number by chance have a few more candidates
    return rows.select(F.xxhash64("value", "entry.band").alias("value"), "class", "n", "place", "label", "entry.own")


def meeting(marked: DataFrame, lists: DataFrame, t: float, k: int) -> DataFrame:
    """Pairs of members of a list with different labels: those without the commonest label meet all others, guests no guests."""
    all_of, few = marked.alias("x"), marked.join(lists.select("value", "most"), "value").where("label <> most").drop("most").alias("y")
    of = lambda s: {c: F.col(f"{s}.{c}") for c in ("n", "place")}
    met = (F.col("x.value") == F.col("y.value")) & (F.col("x.label") != F.col("y.label"))
    if "own" in marked.columns:
        met &= F.col("x.own") | F.col("y.own")
    found = all_of.join(few, met & may_match(of("x"), of("y"), t, k))
    return found.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


class Search:
    """The steps of one search for near duplicates over ``docs`` and its sketch table."""

    def __init__(self, docs: DataFrame, table: DataFrame, size: int, num: int, den: int, k: int = K) -> None:
        self.docs, self.table, self.size, self.num, self.den, self.k = docs, table, size, num, den, k
        self.t = num / den
        self.bitmaps: list[Broadcast] = []
        self.holder = written(table.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "neardup-holders")

    def bits(self, ids: DataFrame, column: str) -> Broadcast:
        """The bitmap of the ids, until ``release``."""
        self.bitmaps.append(bits_of(ids, column))
        return self.bitmaps[-1]

    def release(self) -> None:
        """Delete the bitmaps, once what they pick is written."""
        while self.bitmaps:
            self.bitmaps.pop().destroy()

    def sets(self, classes: DataFrame) -> DataFrame:
        """class, n, set: the whole sets of the given classes, from one document of each."""
        # texts stay where they are: those that may be wanted become sets, and these are joined
        bits = self.bits(self.holder.join(classes, "class", "left_semi"), "doc_id")
        found = full_sets(self.docs, self.size, bits).join(classes, "class", "left_semi").dropDuplicates(["class"])
        sets = written(found.select("class", F.size("set").cast("long").alias("n"), "set"), "neardup-sets")
        self.release()
        return sets

    def sketches(self, classes: DataFrame, k: int) -> DataFrame:
        """class, n, sketch (of k values): the given classes, each at least once, and a few others that share their bits."""
        # sketches stay where they are, whatever the size of the list; no pair meets those that were not asked for
        rows = self.table.where("class IS NOT NULL").select("class", "n", F.slice("sketch", 1, k).alias("sketch"))
        return split(rows, F.col("class"), self.bits(classes, "class"), True, once, rows.schema)

    def crossing_pairs(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of a list that are in different components so far, as a written table."""
        label = lambda df: df.join(labels, F.col("class") == F.col("node"), "left").select("value", "class", "n", "place", F.coalesce("label", "class").alias("label"))
        marked = by_value(label(lists), "neardup-marked")
        lists_of_several = by_value(open_lists(marked), "neardup-open")
        direct = meeting(marked, lists_of_several.where(F.col("few") <= FEW), self.t, self.k)
        dealt = lambda df, name: by_value(df.repartition(parts(self.docs.sparkSession), "value"), name)
        cut = dealt(bands(marked.join(lists_of_several.where(F.col("few") > FEW), "value", "left_semi"), self.t), "neardup-bands")
        open_bands = by_value(open_lists(cut), "neardup-open")
        banded = meeting(cut, open_bands.where(F.col("few") <= FEW), self.t, self.k)
        crowded = written(cut.join(open_bands.where(F.col("few") > FEW), "value", "left_semi").select("class").distinct(), "neardup-crowded")
        whole = self.sets(crowded)
        finer = dealt(label(prefixes(whole, self.t)), "neardup-finer")
        met = direct.unionByName(banded).unionByName(meeting(finer, open_lists(finer), self.t, WHOLE))
        pairs = written(met.distinct(), "neardup-crossing")
        discard(marked, lists_of_several, cut, open_bands, crowded, whole, finer)
        return pairs

    def alike(self, pairs: DataFrame, sketched: DataFrame, k: int, deviations: float) -> DataFrame:
        """The pairs whose union's sketch of k values does not rule the likeness out."""
        t = self.t
        side = lambda s, c: sketched.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.slice("sketch", 1, k).alias(c))
        joined = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b")
        whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
        union = F.array_sort(F.array_union("sa", "sb"))
        top = F.when(whole, union).otherwise(F.slice(union, 1, k))
        share = F.size(F.array_intersect(F.array_intersect(top, F.col("sa")), F.col("sb"))) / F.size(top)
        return joined.where(share >= F.when(whole, t - 1e-9).otherwise(t - deviations * math.sqrt(t * (1 - t) / k))).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of classes with den*|A and B| >= num*|A or B|, as a written table: estimated on the union's sketch, then on full sets."""
        classes = lambda df: df.select(F.col("a").alias("class")).unionByName(df.select(F.col("b").alias("class"))).distinct()
        # one look at a few values first: most pairs end there, and long sketches travel for the rest only
        sketches_of = lambda df, k: self.sketches(classes(df), k).dropDuplicates(["class"])
        glance = written(sketches_of(pairs, GLANCE), "neardup-glance")
        likely = written(self.alike(pairs, glance, GLANCE, GLANCE_DEVIATIONS), "neardup-likely")
        low = written(sketches_of(likely, self.k), "neardup-sketches")
        self.release()
        first, likely = likely, written(self.alike(likely, low, self.k, 5), "neardup-likely")
        sets = self.sets(classes(likely))
        both = likely.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
        union_size = F.size("set_a") + F.size("set_b") - F.col("shared")
        near_pairs = both.withColumn("shared", F.size(F.array_intersect("set_a", "set_b"))).where(self.den * F.col("shared") >= self.num * union_size)
        links = written(near_pairs.select("a", "b"), "neardup-links")
        discard(glance, first, low, likely, sets)
        return links


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, class, component_id, kept.

    Documents are linked when den * |A and B| >= num * |A or B| on their sets of ``size``-word shingles;
    component_id is the smallest doc_id reachable, kept tells doc_id = component_id. A text of fewer words is
    one shingle; a null or empty one has no shingle, no class and no link. Rows with one doc_id and different
    texts are judged each by its own text; a group of null ids alone has component_id null and is not kept by
    this flag (``keep_one`` keeps one of them). An empty table gives none; other columns are ignored.
    """
    t = num / den
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(sketches(docs, size, k), "neardup-sketch")
    search = Search(docs, table, size, num, den, k)
    lists = by_value(leading(table, t, k), "neardup-lists")
    stars = written(star_pairs(lists, t, k), "neardup-stars")
    links = search.verified(stars)
    labels = written(components(links), "neardup-labels")
    crossing = search.crossing_pairs(lists, labels)
    discard(lists, labels)
    more = search.verified(crossing.join(stars, ["a", "b"], "left_anti"))
    labels = written(components(links.unionByName(more)), "neardup-labels")
    discard(stars, crossing, links, more, search.holder)
    rows = table.select("doc_id", "n", "class").join(labels, F.col("class") == F.col("node"), "left")
    rows = written(rows.select("doc_id", "n", "class", F.coalesce("label", "class").alias("label")), "neardup-rows")
    discard(table, labels)
    lowest = rows.where("label IS NOT NULL").groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("lowest"))
    out = rows.join(lowest, F.col("label") == F.col("of"), "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class", "label", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of near duplicates, with all columns: the smallest doc_id, null ids last.

    Texts without words belong to no group and all stay; of rows that repeat id and text one stays.
    """
    columns = docs.columns
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = near_duplicates(ids, size, num, den).where("label IS NOT NULL").select("doc_id", "class", "label")
    rows = written(found.groupBy("doc_id", "class", "label").count(), "neardup-decided")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "class")).alias("best")
    decided = rows.join(rows.groupBy(F.col("label").alias("of")).agg(best), F.col("label") == F.col("of"))
    wins = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("class") == F.col("best.class"))
    mark_name, id_name, of_name = (unused(columns, f"{n}_of_set") for n in ("class", "id", "held"))
    name = lambda df: df.select(F.col("doc_id").alias(id_name), F.col("class").alias(of_name))
    lost, repeated = written(name(decided.where(~wins)), "neardup-lost"), written(name(decided.where(wins & (F.col("count") > 1))), "neardup-repeated")
    at = columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(mark_name, T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [class_of(s) if len(s) else None for s in shingle_sets(batch.column(at), size)]
            yield batch.append_column(mark_name, pa.array(classes, pa.int64()))

    # rows whose id is in neither list stay without a look at their text; only the others meet the lists
    bits = bits_of(lost.select(id_name).unionByName(repeated.select(id_name)), id_name)
    doc_id = F.col("doc_id")
    marked = split(docs, doc_id, bits, True, mark, schema)
    same = doc_id.cast("long").eqNullSafe(F.col(id_name)) & (F.col(mark_name) == F.col(of_name))
    kept = marked.join(lost, same, "left_anti")
    if not repeated.isEmpty():
        twice = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", mark_name])
        kept = kept.join(repeated, same, "left_anti").unionByName(twice)
    return split(docs, doc_id, bits, False).unionByName(kept.select(*[F.col(f"`{c}`") for c in columns]))
