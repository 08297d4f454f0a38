"""Benchmark decontamination: BM25 over an inverted index of test items, queried by every training passage.

Items are the documents of the index, passages of training texts its queries. The impact of a term on an item
is its BM25 weight divided by the sum of the item's weights, so a passage with all of an item's terms scores 1
on it and one threshold serves items of any length. A count over the rarer terms of each item finds the passages in
which an item can reach the threshold at all; for these, block-max WAND retrieves every item that does; each is then verified by the share of its question's and of its answer's five-word runs that the
passage holds. Items are indexed by classes of length, the powers of two; passages for a class are twice as long as
its longest possible item and overlap by half, so each item-long stretch of a text lies whole inside one, and what
is found of an item does not hang on how long other items are.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.ship import ship
from varve.llm.textbytes import Words, shingle_hashes, slabs, word_hashes, words
from varve.sources.shared import discard, written

K1, B, RUN, BLOCK = 1.2, 0.75, 5, 64
#: Words of the shortest length class; each further one is twice as long.
LEAST_REACH = 16
SENTENCE_END = (0x2E, 0x21, 0x3F)


@dataclass
class Posting:
    """A term's items in order with their impacts, and the last item and highest impact of each block."""

    items: list[int]
    impacts: list[float]
    last: list[int]
    most: list[float]
    top: float


@dataclass
class Essential:
    """Postings without which no item reaches the threshold: bounds per term, items, impacts; what each item still needs of them."""

    bounds: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    needed: np.ndarray

    @classmethod
    def of(cls, term: np.ndarray, terms: int, item: np.ndarray, items: int, impact: np.ndarray, df: np.ndarray, threshold: float) -> Essential:
        """Of each item its most common terms are left out as long as their impacts stay below the threshold."""
        order = np.lexsort((-df, item))
        running = np.cumsum(impact[order])
        start = np.searchsorted(item[order], item[order])
        running -= running[start] - impact[order][start]
        out = running < 0.4 * threshold
        left_out = np.bincount(item[order][out], weights=impact[order][out], minlength=items)
        kept = np.sort(order[~out])
        return cls(np.searchsorted(term[kept], np.arange(terms + 1)), item[kept], impact[kept], threshold - left_out)

    def windows(self, term: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Which of the given windows (one for each occurrence of a term) may hold an item."""
        n = self.bounds[term + 1] - self.bounds[term]
        window = np.repeat(window, n)
        at = np.arange(len(window)) + np.repeat(self.bounds[term] - (np.cumsum(n) - n), n)
        key = window * len(self.needed) + self.items[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        if not len(start):
            return start
        mass = np.add.reduceat(self.impacts[at][order], start)
        return np.unique(key[start][mass >= self.needed[key[start] % len(self.needed)] - 1e-9] // len(self.needed))


@dataclass
class Index:
    """Of one length class: terms in order, posting of each, and per item its id (None if it has none) and the run hashes of its question and answer.

    ``reach`` is the most words an item of the class can have.
    """

    terms: np.ndarray
    postings: list[Posting]
    tops: np.ndarray
    essential: Essential
    ids: list[int | None]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    reach: int

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose summed impact over the given terms reaches the threshold, by block-max WAND."""
        cursors = [[p.items[0], 0, p] for p in (self.postings[t] for t in terms)]
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2].top
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            blocks = [bisect_left(c[2].last, item) for c in ahead]
            if sum(c[2].most[b] for c, b in zip(ahead, blocks) if b < len(c[2].most)) < threshold:
                # no item up to the nearest block end can reach the threshold
                ends = [c[2].last[b] + 1 for c, b in zip(ahead, blocks) if b < len(c[2].last)]
                target = min([*ends, *([cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else [])], default=item + 1)
                target = max(target, item + 1)
            else:
                for c in ahead:
                    if c[0] < item:
                        self._seek(c, item)
                score = sum(c[2].impacts[c[1]] for c in ahead if c[0] == item)
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            for c in ahead:
                if c[0] < target:
                    self._seek(c, target)
            cursors = [c for c in cursors if c[1] < len(c[2].items)]

    @staticmethod
    def _seek(cursor: list, item: int) -> None:
        posting = cursor[2]
        cursor[1] = bisect_left(posting.items, item, cursor[1])
        cursor[0] = posting.items[cursor[1]] if cursor[1] < len(posting.items) else 1 << 62


def _answer_start(data: np.ndarray, ends: np.ndarray) -> int:
    """The first word of the last sentence; half of the words where there is one sentence."""
    stops = [i for i in range(len(ends) - 1) if data[ends[i] - 1] in SENTENCE_END]
    return stops[-1] + 1 if stops else len(ends) // 2


def item_terms(items: DataFrame) -> DataFrame:
    """item, length, term, tf for each term of each item; items without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for slab in slabs(batch.column(1)):
                w = words(slab)
                hashes = word_hashes(w)
                for i in range(slab.rows):
                    own = hashes[w.bounds[i] : w.bounds[i + 1]]
                    term, tf = np.unique(own, return_counts=True)
                    ids += [batch.column(0)[slab.first + i].as_py()] * len(term)
                    lengths += [len(own)] * len(term)
                    terms.append(term)
                    tfs.append(tf)
            flat = lambda parts: np.concatenate([*parts, np.zeros(0, dtype=np.int64 if parts is tfs else np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(flat(terms).view(np.int64)), pa.array(flat(tfs).astype(np.int64))], names=["item", "length", "term", "tf"])

    return items.select("item", "text").mapInArrow(run, "item long, length long, term long, tf long")


def indexes(items: DataFrame, threshold: float, block_words: int) -> Iterator[list[Index]]:
    """Blocks of indexes over all items, one for each length class in a block of about ``block_words`` words; statistics are those of all items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    # a row without id that repeats the text of one with an id says nothing new
    named = items.where("item_id IS NOT NULL").select(F.col("text").alias("named")).distinct()
    items = items.join(named, F.col("item_id").isNull() & (F.col("text") == F.col("named")), "left_anti").withColumn("item", F.xxhash64("item_id", "text"))
    terms = written(item_terms(items), "item-terms")
    stats = terms.select("item", "length").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg"), F.sum("length").alias("words")).first()
    blocks = max(1, math.ceil((stats["words"] or 0) / block_words))
    of = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    # cut into blocks once; each is then read alone
    weighted = written(terms.join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").select("*", of), "item-weights")
    texts_of = written(items.select("item", "item_id", "text", of), "item-texts")
    discard(terms)
    for b in range(blocks):
        table, texts = weighted.where(F.col("block") == b).drop("block").toArrow(), texts_of.where(F.col("block") == b).orderBy("item").toArrow()
        if not table.num_rows:
            continue
        reach = np.maximum(LEAST_REACH, 1 << np.ceil(np.log2(np.maximum(table.column("length").to_numpy(), 1))).astype(np.int64))
        yield [_index(table.filter(pa.array(reach == r)), texts, stats["n"], stats["avg"], threshold, int(r)) for r in np.unique(reach)]
    discard(weighted, texts_of)


def _index(table: pa.Table, texts: pa.Table, n: int, average: float, threshold: float, reach: int) -> Index:
    number, length, term, tf, df = (table.column(c).to_numpy() for c in ("item", "length", "term", "tf", "df"))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    numbers, item = np.unique(number, return_inverse=True)
    impact = weight / np.bincount(item, weights=weight)[item]
    keys = term.view(np.uint64)
    order = np.lexsort((item, keys))
    keys, item, impact, df = keys[order], item[order], impact[order], df[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    postings = []
    for a, z in zip(starts, np.r_[starts[1:], len(keys)]):
        own, value = item[a:z].tolist(), impact[a:z].tolist()
        cuts = range(0, len(own), BLOCK)
        postings.append(Posting(own, value, [own[min(c + BLOCK, len(own)) - 1] for c in cuts], [max(value[c : c + BLOCK]) for c in cuts], max(value)))
    questions, answers, place = {}, {}, {int(x): k for k, x in enumerate(numbers)}
    column = texts.column("text").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    names, ids = texts.column("item").to_pylist(), dict(zip(texts.column("item").to_pylist(), texts.column("item_id").to_pylist()))
    for slab in slabs(column):
        w = words(slab)
        hashes = word_hashes(w)
        for i in range(slab.rows):
            k = place.get(names[slab.first + i])
            if k is None:
                continue
            a, z = w.bounds[i], w.bounds[i + 1]
            cut = _answer_start(w.low, w.ends[a:z])
            questions[k], answers[k] = _runs(hashes[a : a + cut]), _runs(hashes[a + cut : z])
    tops = np.array([p.top for p in postings])
    place_of = np.searchsorted(keys[starts], keys)
    essential = Essential.of(place_of, len(starts), item, len(numbers), impact, df, threshold)
    return Index(keys[starts], postings, tops, essential, [ids[int(x)] for x in numbers], [questions[k] for k in range(len(numbers))], [answers[k] for k in range(len(numbers))], reach)


def _runs(hashes: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(hashes, np.array([0, len(hashes)]), RUN)[0])


def _held(wanted: np.ndarray, hashes: np.ndarray) -> float:
    """Share of the wanted runs found in a passage; a part shorter than a run is looked for as it is."""
    if not len(wanted):
        return 1.0
    there = [shingle_hashes(hashes, np.array([0, len(hashes)]), RUN)[0]]
    if len(wanted) == 1:
        there += [_short(hashes, n) for n in range(1, RUN)]
    return float(np.isin(wanted, np.concatenate(there)).mean())


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n < RUN words as a part of just n words has it."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(len(hashes) - n + 1)[:, None] + np.arange(n)
    return shingle_hashes(hashes[at].ravel(), np.arange(len(at) + 1) * n, RUN)[0]


def hits_of(block: list[Index], texts: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, dict[tuple[int, int], tuple]]]:
    """For each text with hits its row and, per item (index of the block, item), the best (score, question, answer, first word) verified."""
    for slab in slabs(texts):
        w = words(slab)
        hashes = word_hashes(w)
        best: dict[int, dict[tuple[int, int], tuple]] = {}
        for number, index in enumerate(block):
            _search(index, number, w, hashes, slab.rows, threshold, overlap, best)
        for r in sorted(best):
            yield slab.first + r, best[r]


def _search(index: Index, number: int, w: Words, hashes: np.ndarray, rows: int, threshold: float, overlap: float, best: dict) -> None:
    """Query one index by all passages of a slab; what is found goes to ``best``."""
    step, passage = index.reach, 2 * index.reach
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = index.terms[at] == hashes
    counts = np.diff(w.bounds)
    n = np.maximum(1, -(-(counts - step) // step))
    row = np.repeat(np.arange(rows), n)
    first = w.bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
    last = np.minimum(first + passage, w.bounds[row + 1])
    # a word lies in the window that begins in its stretch of ``step`` words and in the one before
    where = np.flatnonzero(known)
    of = np.repeat(np.arange(rows), counts)[where]
    stretch, base = (where - w.bounds[of]) // step, np.cumsum(n) - n
    inside = [(stretch - k >= 0) & (stretch - k < n[of]) for k in (0, 1)]
    spots = np.concatenate([where[i] for i in inside])
    window = np.concatenate([(base[of] + stretch - k)[i] for k, i in enumerate(inside)])
    for k in index.essential.windows(at[spots], window):
        a, z = int(first[k]), int(last[k])
        terms = np.unique(at[a:z][known[a:z]])
        if index.tops[terms].sum() < threshold - 1e-9:
            continue
        for item, score in index.retrieve(terms.tolist(), threshold - 1e-9):
            asked, answered = _held(index.question[item], hashes[a:z]), _held(index.answer[item], hashes[a:z])
            if asked >= overlap and answered >= overlap:
                own = best.setdefault(int(row[k]), {})
                own[number, item] = max(own.get((number, item), (0.0,)), (score, asked, answered, a - int(w.bounds[row[k]])))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, question_overlap, answer_overlap, first_word.

    The answer of an item is its last sentence, or its second half where it has one sentence. Items without
    words and null or empty texts give nothing; repeated documents give repeated rows. Items are told apart by id
    and text: texts that share an id are items of their own, and a text that has no id is reported with item_id
    null. Items beyond ``block_words`` words are indexed in further blocks, for each of which the documents are read
    again; rows do not depend on it, nor, but for the weights that BM25 takes from all items, on which other items
    there are. ``first_word`` is where the passage begins. Texts of any length are cut into passages; other columns
    are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    out = spark.createDataFrame([], schema)
    for block in indexes(items, threshold, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column(0)[r].as_py(), shared.value[c].ids[i], *found) for r, own in hits_of(shared.value, batch.column(1), threshold, overlap) for (c, i), found in sorted(own.items())]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """The documents in which no test item is found, with all their columns; same rules as ``contaminated``."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index("text")
    for block in indexes(items, threshold, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r for r, _ in hits_of(shared.value, batch.column(at), threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
