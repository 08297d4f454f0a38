"""Scoring texts by context-tree weighting over bytes.

A text is its words in lower case, one blank between them and an end mark. Each byte is eight binary choices;
a choice is predicted in the contexts of the 0 to ``DEPTH`` bytes before it by Krichevsky-Trofimov estimates
from all training texts, and the estimates of all depths are mixed by the weights of the context tree: at each
node, how much better it codes the training data itself than its longer contexts together do.

Counting is a map-side count of (DEPTH+1)-grams and one grouped sum; the tree is then folded one depth at a
time by grouped sums. The ``max_nodes`` nodes seen most often are broadcast, so that has a fixed bound; grams
whose longest contexts are not among them are joined with the written rest of the tree, so every node counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.columns import crc32_of
from varve.llm.ship import ship
from varve.llm.textbytes import IS_SPACE, Slab, Words, mix, slabs, word_hashes, words
from varve.sources.shared import written

DEPTH = 5
END = 0x0A
GRAM, WORD = 0, 1


def stream(w: Words, slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all (DEPTH+1)-grams of the texts, the newest byte lowest, and their bounds per text.

    Before its first byte a text has end marks.
    """
    counts = np.diff(w.bounds)
    row = np.repeat(np.arange(slab.rows), counts)
    size = w.ends - w.starts + 1
    empty = counts == 0
    before = DEPTH * (row + 1) + np.cumsum(empty)[row]
    separator = np.cumsum(size) - 1 + before
    length = np.bincount(row, weights=size, minlength=slab.rows).astype(np.int64) + empty
    bounds = np.r_[0, np.cumsum(length)]
    out = np.full(int(bounds[-1]) + DEPTH * slab.rows, END, dtype=np.uint8)
    begin = bounds[:-1] + DEPTH * np.arange(slab.rows)
    text = np.ones(len(out), dtype=bool)
    text[separator] = False
    text[(begin + DEPTH)[empty]] = False
    text[(begin[:, None] + np.arange(DEPTH)).ravel()] = False
    out[text] = w.low[~IS_SPACE[w.low]]
    out[separator[np.r_[row[1:] == row[:-1], np.zeros(min(1, len(row)), dtype=bool)]]] = 0x20
    codes = np.zeros(len(out) - DEPTH, dtype=np.uint64)
    for j in range(DEPTH + 1):
        codes |= out[DEPTH - j : len(out) - j].astype(np.uint64) << np.uint64(8 * j)
    inside = np.ones(len(codes), dtype=bool)
    inside[(begin[1:, None] - np.arange(1, DEPTH + 1)).ravel() + 0] = False  # codes that end in a later text's leading marks
    return codes[inside], bounds


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts."""
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        return keys[at], np.diff(np.r_[at, len(keys)])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def counted(texts: DataFrame) -> DataFrame:
    """kind, key, n over all texts: how often each gram and each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [], WORD: []}
        for batch in batches:
            for slab in slabs(batch.column(0)):
                w = words(slab)
                held[GRAM].append(tally(stream(w, slab)[0]))
                held[WORD].append(tally(word_hashes(w)))
            for kind, parts in held.items():
                if sum(len(p[0]) for p in parts) > 3_000_000:
                    held[kind] = [tally(*map(np.concatenate, zip(*parts)))]
        for kind, parts in held.items():
            if parts:
                keys, n = tally(*map(np.concatenate, zip(*parts)))
                for k in range(0, len(keys), 65_536):
                    part = keys[k : k + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, dtype=np.int8)), pa.array(part.view(np.int64)), pa.array(n[k : k + 65_536].astype(np.int64))], names=["kind", "key", "n"])

    return texts.select("text").mapInArrow(run, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 7, brought back by the recurrence."""
    y = x + 7
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def kt(n0: Column, n1: Column) -> Column:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def tree(grams: DataFrame) -> DataFrame:
    """depth, context, node, n0, n1, beta: all nodes; beta is the log of own over longer contexts' probability."""
    byte = F.col("key").bitwiseAND(255)
    steps = F.array(*[F.struct((F.shiftright(byte, 8 - k) + (1 << k)).alias("node"), F.shiftright(byte, 7 - k).bitwiseAND(1).alias("bit")) for k in range(8)])
    bits = grams.select(F.shiftright("key", 8).alias("context"), "n", F.explode(steps).alias("s"))
    one = F.col("n") * F.col("s.bit")
    level = bits.groupBy("context", F.col("s.node").cast("int").alias("node")).agg(F.sum(F.col("n") - one).alias("n0"), F.sum(one).alias("n1"))
    level = written(level.withColumn("own", kt(F.col("n0"), F.col("n1"))).withColumns({"mixed": F.col("own"), "beta": F.lit(0.0)}), f"ctw-{DEPTH}")
    levels = [level.withColumn("depth", F.lit(DEPTH))]
    for depth in range(DEPTH - 1, -1, -1):
        shorter = F.col("context").bitwiseAND((1 << (8 * depth)) - 1).alias("context")
        level = level.groupBy(shorter, "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("mixed").alias("longer"))
        level = level.withColumn("own", kt(F.col("n0"), F.col("n1"))).withColumn("beta", F.col("own") - F.col("longer"))
        both = F.greatest("own", "longer") + F.log1p(F.exp(-F.abs("beta"))) - math.log(2)
        level = written(level.withColumn("mixed", both).drop("longer"), f"ctw-{depth}")
        levels.append(level.withColumn("depth", F.lit(depth)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("depth", "context", "node", "n0", "n1", F.round("beta", 4).alias("beta"))


def most_counted(df: DataFrame, n: Column, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with the highest n, as many whole classes of about equal n as fit into ``limit`` rows, and the rest if there is one."""
    step = F.floor(F.log2(n) * 16).cast("int")
    left, least = limit, None
    # a class for each sixteenth of a power of two
    for row in df.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if row["count"] > left:
            return (df.where(F.lit(False)), df) if least is None else (df.where(step >= least), df.where(step < least))
        left, least = left - row["count"], row["step"]
    return df, None


class Nodes:
    """Nodes of the tree as arrays in the order of their keys."""

    def __init__(self, keys: np.ndarray, one: np.ndarray, own: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.one, self.own = keys[order], one[order], own[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def node_keys(codes: np.ndarray, depth: int) -> list[np.ndarray]:
    """The keys of the eight nodes that a gram meets at a depth."""
    byte = codes & np.uint64(255)
    base = np.uint64(depth << 56) | ((codes >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8)
    return [base | (byte >> np.uint64(8 - k)) + np.uint64(1 << k) for k in range(8)]


class Model:
    """The broadcast nodes and frequent words as arrays, looked up for many keys at once; ``whole`` if these are all nodes."""

    def __init__(self, nodes: pa.Table, frequent: pa.Table, whole: bool = True, slots: int = 1 << 20) -> None:
        self.nodes = Nodes(nodes.column("key").to_numpy().view(np.uint64), nodes.column("one").to_numpy(), nodes.column("own").to_numpy())
        self.whole = whole
        hashes, counts = frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
        order = np.argsort(counts, kind="stable")  # in one slot the most frequent word stays
        self.words, self.counts = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.int64)
        at = (hashes[order] & np.uint64(slots - 1)).astype(np.int64)
        self.words[at], self.counts[at] = hashes[order], counts[order]
        self.cache: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the probability of each gram's last byte given the bytes before it, NaN where that takes the rest of the tree.

        Grams seen before are kept in the worker.
        """
        if self.cache is None:
            self.cache = np.full(1 << 21, ~np.uint64(0)), np.zeros(1 << 21, dtype=np.float32)
        kept, values = self.cache
        slot = (mix(codes.copy()) & np.uint64(len(kept) - 1)).astype(np.int64)
        missing = kept[slot] != codes
        out = values[slot]
        if missing.any():
            new, _ = tally(codes[missing])
            fresh = np.full(len(new), np.nan, dtype=np.float32)
            settled = np.ones(len(new), dtype=bool) if self.whole else ~self.missing(new, DEPTH)
            fresh[settled] = self.mixture(new[settled])
            out[missing] = fresh[np.searchsorted(new, codes[missing])]
            slot = (mix(new.copy()) & np.uint64(len(kept) - 1)).astype(np.int64)
            kept[slot] = new
            values[slot] = fresh[np.searchsorted(new, kept[slot])]
        return out

    def missing(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Whether a gram meets a node of this depth that is not here."""
        out = np.zeros(len(codes), dtype=bool)
        for key in node_keys(codes, depth):
            out |= ~self.nodes.find(key)[1]
        return out

    def mixture(self, codes: np.ndarray, rest: Nodes | None = None) -> np.ndarray:
        """log2 of the probabilities from the nodes here and those of the rest."""
        total = np.zeros(len(codes), dtype=np.float32)
        tables = [t for t in (self.nodes, rest) if t is not None and len(t.keys)]
        if not tables:
            return total - 8
        keys = [node_keys(codes, depth) for depth in range(DEPTH + 1)]
        for k in range(8):
            p, seen = np.full(len(codes), 0.5, dtype=np.float32), np.zeros(len(codes), dtype=bool)
            for depth in range(DEPTH, -1, -1):
                for table in tables:
                    at, found = table.find(keys[depth][k])
                    weight = np.where(seen, table.own[at], np.float32(1))
                    p = np.where(found, weight * table.one[at] + (1 - weight) * p, p)
                    seen |= found
            bit = (codes >> np.uint64(7 - k)) & np.uint64(1)
            total += np.log2(np.where(bit == 1, p, 1 - p))
        return total


def fit(spark, counts: DataFrame, max_nodes: int, max_words: int) -> Model:
    return fit_and_rest(counts, max_nodes, max_words)[0]


def fit_and_rest(counts: DataFrame, max_nodes: int, max_words: int) -> tuple[Model, DataFrame | None]:
    """The model to broadcast, and key, one, own of the nodes that are not in it."""
    nodes = tree(counts.where(F.col("kind") == GRAM))
    kept, rest = most_counted(nodes, F.col("n0") + F.col("n1"), max_nodes)
    key = F.shiftleft(F.col("depth").cast("long"), 56).bitwiseOR(F.shiftleft("context", 8)).bitwiseOR(F.col("node").cast("long"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    own = 1 / (1 + F.exp(-F.greatest(F.lit(-80.0), F.least(F.lit(80.0), F.col("beta")))))
    columns = [key.alias("key"), one.cast("float").alias("one"), own.cast("float").alias("own")]
    frequent = most_counted(counts.where(F.col("kind") == WORD).select("key", "n"), F.col("n"), max_words)[0].toArrow()
    return Model(kept.select(*columns).toArrow(), frequent, rest is None), None if rest is None else rest.select(*columns)


def settled_by_join(grams: DataFrame, rest: DataFrame, model) -> DataFrame:
    """gram, bits: log2 of the probability of each distinct gram, by the broadcast model and the rest of the tree.

    A gram is joined with the rest once for each depth at which it misses a node: all nodes of one context there
    are one row, of which the gram takes the eight that it meets.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            for depth in range(DEPTH, -1, -1):
                codes = codes[model.value.missing(codes, depth)]  # a context is seen as often as its longer ones, at least
                if not len(codes):
                    break
                at = node_keys(codes, depth)[0] & ~np.uint64(255)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(at.view(np.int64))], names=["gram", "at"])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).flatten().flatten()
            key, one, own = (found.field(c).to_numpy(zero_copy_only=False) for c in ("key", "one", "own"))
            key, first = np.unique(key.view(np.uint64), return_index=True)
            bits = model.value.mixture(batch.column(0).to_numpy().view(np.uint64), Nodes(key, one[first], own[first]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.astype(np.float64))], names=["gram", "bits"])

    at = F.col("key").bitwiseAND(~255)
    by_context = rest.groupBy(at.alias("at")).agg(F.collect_list(F.struct("key", "one", "own")).alias("nodes"))
    byte = F.col("gram").bitwiseAND(255)
    met = F.array(*[F.col("at").bitwiseOR(F.shiftright(byte, 8 - k) + (1 << k)) for k in range(8)])
    own = F.filter("nodes", lambda n: F.array_contains(F.col("met"), n["key"]))
    joined = grams.mapInArrow(contexts, "gram long, at long").join(by_context, "at", "left").withColumn("met", met)
    return joined.select("gram", own.alias("nodes")).groupBy("gram").agg(F.collect_list("nodes").alias("nodes")).mapInArrow(values, "gram long, bits double")


def scores(docs: DataFrame, max_nodes: int = 1 << 21, max_words: int = 1 << 19) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the texts whose crc32(doc_id) mod 5 is not 1. Tokens are words and one end per text; base_score
    is the smoothed unigram score, score the context tree's log10 probability of the same tokens. Null and
    empty texts are one end token. A null id is held_out null and not learned from. Without training texts the
    tree predicts evenly. Frequent nodes and words are looked up in broadcast tables of fixed size, all others
    by joins, so the results do not depend on these sizes. Repeated rows give repeated results, an empty table none.
    """
    spark = docs.sparkSession
    ship(spark)
    remainder = crc32_of(F.col("doc_id")) % 5
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = docs.where(remainder != 1)
    counts = written(counted(training), "ctw-counts")
    word_counts = counts.where(F.col("kind") == WORD)
    total = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = training.count()
    n_all, distinct = total["n"] + ends, total["v"] + (1 if ends else 0)
    floor = math.log10(n_all + 0.5 * (distinct + 1))
    fitted, rest = fit_and_rest(counts, max_nodes, max_words)
    model = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(slab.first, slab.rows), batch.column(1).slice(slab.first, slab.rows), *_score(model.value, slab)], names=["doc_id", "row", "n_words", "n_known", "known", "bits", "n_bytes", "word", "times", "gram", "often"])

    schema = "doc_id long, row long, n_words long, n_known long, known double, bits double, n_bytes long, word array<long>, times array<long>, gram array<long>, often array<int>"
    # once written, the number of a row stays
    scored = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema), "ctw-scored")
    rare = scored.where(F.size("word") > 0).select("row", F.explode(F.arrays_zip("word", "times")).alias("w")).select("row", "w.word", "w.times")
    found = rare.join(word_counts.select(F.col("key").alias("word"), "n"), "word", "left")
    per_row = found.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known")
    )
    out = scored.drop("word", "times", "gram", "often").join(per_row, F.col("row") == F.col("of"), "left")
    if rest is not None:
        values = settled_by_join(scored.select(F.explode("gram").alias("gram")).distinct(), rest, model)
        uses = scored.where(F.size("gram") > 0).select("row", F.explode(F.arrays_zip("gram", "often")).alias("g")).select("row", "g.gram", "g.often")
        rest_bits = uses.join(values, "gram").groupBy(F.col("row").alias("by")).agg(F.sum(F.col("often") * F.col("bits")).alias("rest_bits"))
        out = out.join(rest_bits, F.col("row") == F.col("by"), "left").withColumn("bits", F.col("bits") + F.coalesce("rest_bits", F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_tokens = F.col("n_words") + 1
    return out.select(
        "doc_id",
        (crc32_of(F.col("doc_id")) % 5 == 1).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + zero("rest_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("known") + zero("rest") + math.log10(ends + 0.5) - n_tokens * floor).alias("base_score"),
        (F.col("bits") * math.log10(2)).alias("score"),
        (-F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _score(model: Model, slab: Slab) -> list[pa.Array]:
    w = words(slab)
    codes, bounds = stream(w, slab)
    bits = model.log2(codes).astype(np.float64)
    open_ = np.isnan(bits)
    grams = _per_row(codes[open_], np.repeat(np.arange(slab.rows), np.diff(bounds))[open_], slab.rows, np.int32)
    bits = np.add.reduceat(np.where(open_, 0, bits), bounds[:-1])
    hashes, counts = word_hashes(w), np.diff(w.bounds)
    row = np.repeat(np.arange(slab.rows), counts)
    slot = (hashes & np.uint64(len(model.words) - 1)).astype(np.int64)
    count = np.where(model.words[slot] == hashes, model.counts[slot], 0)
    frequent = count > 0
    known = np.bincount(row, weights=np.where(frequent, np.log10(count + 0.5), 0), minlength=slab.rows).astype(np.float64)
    n_known = np.bincount(row[frequent], minlength=slab.rows)
    return [
        pa.array(counts.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(known), pa.array(bits), pa.array(np.diff(bounds)),
        *_per_row(hashes[~frequent], row[~frequent], slab.rows, np.int64), *grams,
    ]


def _per_row(keys: np.ndarray, of: np.ndarray, rows: int, kind: type) -> list[pa.Array]:
    """Two lists per row: its distinct keys and how often it has each."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])][: len(keys)])
    offsets = pa.array(np.searchsorted(of[at], np.arange(rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (keys[at].view(np.int64), np.diff(np.r_[at, len(keys)]).astype(kind))]
