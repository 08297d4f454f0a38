"""A byte-level convolutional network that tells good texts from junk, in numpy.

Bytes are embedded; filters over 16 bytes move in steps of 4; their responses are max-pooled inside chunks of
512 bytes whose windows reach into the next chunk, so the chunks overlap and together cover the whole text.
The largest and the mean response over all chunks go through one hidden layer to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.columns import crc32_of
from varve.llm.ship import ship
from varve.llm.textbytes import slabs

STEP, PARTS, CHUNK = 4, 4, 128  # bytes of a block, blocks of a window, windows of a chunk
EMBED, FILTERS, HIDDEN, PAD = 8, 32, 16, 256
#: Bytes of text whose responses are held at once, a whole number of chunks; about 200 bytes of memory for each.
RUN_BYTES = 128 * CHUNK * STEP


@dataclass
class Blocks:
    """Texts padded to whole blocks: byte ids, and the chunks with their first and last window and their text."""

    ids: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    texts: int


def blocks(data: np.ndarray, offsets: np.ndarray) -> Blocks:
    sizes = np.diff(offsets)
    windows = np.maximum(1, -(-sizes // STEP))
    starts = np.r_[0, np.cumsum(windows + PARTS - 1)]
    ids = np.full(int(starts[-1]) * STEP, PAD, dtype=np.int16)
    ids[np.arange(len(data)) + np.repeat(starts[:-1] * STEP - offsets[:-1], sizes)] = data
    chunks = -(-windows // CHUNK)
    text = np.repeat(np.arange(len(sizes)), chunks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = starts[text] + nth * CHUNK
    return Blocks(ids, first, np.minimum(first + CHUNK, starts[text] + windows[text]), text, len(sizes))


@dataclass
class Network:
    """embedding (257, EMBED), filters (PARTS*STEP*EMBED, FILTERS) with bias, hidden layer, output layer."""

    weights: list[np.ndarray]

    @classmethod
    def new(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        width = PARTS * STEP * EMBED
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        zeros = lambda *shape: np.zeros(shape, dtype=np.float32)
        return cls([normal(257, EMBED, scale=0.5), normal(width, FILTERS, scale=width**-0.5), zeros(FILTERS), normal(2 * FILTERS, HIDDEN, scale=0.15), zeros(HIDDEN), normal(HIDDEN, 1, scale=0.3), zeros(1)])

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Filter responses of the windows that begin at each block."""
        embedding, filters, bias = self.weights[:3]
        block = embedding[ids].reshape(-1, STEP * EMBED)
        parts = block @ np.concatenate(np.split(filters, PARTS), axis=1)
        n = len(block) - PARTS + 1
        out = parts[:n, :FILTERS] + bias
        for j in range(1, PARTS):
            out += parts[j : j + n, j * FILTERS : (j + 1) * FILTERS]
        return out

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.weights[3] + self.weights[4], 0)
        z = np.clip((hidden @ self.weights[5] + self.weights[6])[:, 0].astype(np.float64), -40, 40)
        return hidden, 1 / (1 + np.exp(-z))

    def chunk_maxima(self, b: Blocks) -> np.ndarray:
        """The largest response of every filter in each chunk, at least 0."""
        response = self.responses(b.ids)
        ends = np.minimum(np.c_[b.first, b.last].ravel(), len(response) - 1)
        best = np.maximum.reduceat(response, ends)[::2]
        if b.last[-1] == len(response):  # the last index was cut by one
            best[-1] = response[b.first[-1] :].max(axis=0)
        return np.maximum(best, 0)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest and mean response over the chunks of each text; one long text is walked in runs of chunks."""
        if len(offsets) > 2 or len(data) <= RUN_BYTES:
            b = blocks(data, offsets)
            return pool(self.chunk_maxima(b), b.text, b.texts)
        top, total, n = np.zeros(FILTERS, dtype=np.float32), np.zeros(FILTERS), 0
        for run in runs_of(data):
            best = self.chunk_maxima(run)
            top = np.maximum(top, best.max(axis=0))
            total += best.sum(axis=0, dtype=np.float64)
            n += len(best)
        return np.concatenate([top, (total / n).astype(np.float32)])[None, :]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A probability for each text."""
        return self.head(self.pooled(data, offsets))[1]


def runs_of(data: np.ndarray) -> Iterator[Blocks]:
    """One text in runs of whole chunks; the windows at a run's end reach into the next run."""
    for at in range(0, len(data), RUN_BYTES):
        piece = data[at : at + RUN_BYTES + (PARTS - 1) * STEP]
        b = blocks(piece, np.array([0, len(piece)]))
        windows = -(-min(RUN_BYTES, len(data) - at) // STEP)  # windows that begin in this run
        chunks = -(-windows // CHUNK)
        yield Blocks(b.ids[: (windows + PARTS - 1) * STEP], b.first[:chunks], np.minimum(b.last[:chunks], windows), b.text[:chunks], 1)


def pool(chunks: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Largest and mean response over the chunks of each text."""
    starts = np.searchsorted(text, np.arange(texts))
    counts = np.bincount(text, minlength=texts)[:, None]
    mean = (np.add.reduceat(chunks.astype(np.float64), starts) / counts).astype(np.float32)
    return np.concatenate([np.maximum.reduceat(chunks, starts), mean], axis=1)


def train(texts: list[bytes], labels: list[int], steps: int = 1200, batch: int = 32, rate: float = 3e-3, seed: int = 1) -> Network:
    """Adam on the cross-entropy; each text enters whole. Without texts of both labels the result is the constant share."""
    net = Network.new(seed)
    y_all = np.asarray(labels, dtype=np.float64)
    if not len(texts) or y_all.min() == y_all.max():
        net.weights[5][:] = 0
        net.weights[6][:] = 0.0 if not len(texts) else (10.0 if y_all[0] else -10.0)
        return net
    rng = np.random.default_rng(seed + 1)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.r_[order, rng.permutation(len(texts))]
        chosen, order = order[:batch], order[batch:]
        own = [np.frombuffer(texts[i], dtype=np.uint8) for i in chosen]
        gradients = _gradients(net, np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])], y_all[chosen])
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for w, g, (m, v) in zip(net.weights, gradients, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _gradients(net: Network, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    b = blocks(data, offsets)
    best, won = [], []  # chunk x filter: the largest response and its window
    for at in range(0, len(b.first), 256):
        first, last = b.first[at : at + 256], b.last[at : at + 256]
        response = net.responses(b.ids[first[0] * STEP : (last[-1] + PARTS - 1) * STEP])
        index = np.minimum(first[:, None] + np.arange(CHUNK), last[:, None] - 1)
        own = index[np.arange(len(index))[:, None], response[index - first[0]].argmax(axis=1)]
        won.append(own)
        best.append(np.maximum(response[own - first[0], np.arange(FILTERS)], 0))
    best, won = np.concatenate(best), np.concatenate(won)
    pooled = pool(best, b.text, b.texts)
    hidden, p = net.head(pooled)
    dz = ((p - y) / len(y)).astype(np.float32)[:, None]
    d_hidden = dz @ net.weights[5].T * (hidden > 0)
    d_pooled = d_hidden @ net.weights[3].T
    counts = np.bincount(b.text, minlength=b.texts)[:, None]
    top = best == pooled[b.text, :FILTERS]  # equal chunks all count as the largest one
    ties = np.add.reduceat(top, np.searchsorted(b.text, np.arange(b.texts)), dtype=np.float32)
    d_best = (d_pooled[:, :FILTERS] / ties)[b.text] * top + (d_pooled[:, FILTERS:] / counts)[b.text]
    d_best = (d_best * (best > 0)).astype(np.float32)
    ids = b.ids.reshape(-1, STEP)[won[..., None] + np.arange(PARTS)].reshape(*won.shape, PARTS * STEP)
    seen = net.weights[0][ids].reshape(*won.shape, -1)
    d_filters = np.einsum("cf,cfk->kf", d_best, seen)
    d_seen = d_best[..., None] * net.weights[1].T
    flat = ids.ravel()
    by_dim = d_seen.reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(flat, weights=by_dim[:, k], minlength=257) for k in range(EMBED)], axis=1)
    return [d_embed, d_filters, d_best.sum(axis=0), pooled.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ dz, dz.sum(axis=0)]


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, total_bytes: int, longest: int) -> tuple[list[bytes], list[int]]:
    """A hash-ordered sample of labelled texts whose crc32(doc_id) mod 4 is not 2: at most ``rows`` and ``total_bytes``.

    Ids with null or contradicting labels are left out, and so are texts of more than ``longest`` bytes.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    marked = marked.where("id IS NOT NULL AND label IN (0, 1)").where(crc32_of(F.col("id")) % 4 != 2)
    one = marked.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    # a stale label without a document only makes the sample smaller
    chosen = one.select("id", "label", F.xxhash64("id", F.lit(5)).alias("turn")).orderBy("turn", "id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.where(F.octet_length("text") <= longest).join(chosen, "id").select("turn", "id", "text", "label").orderBy("turn", "id", "text")
    x, y, used = [], [], 0
    for row in sample.toLocalIterator():
        raw = row.text.encode()
        used += len(raw)
        if used > total_bytes or len(x) == rows:  # a repeated id brings several texts
            break
        x.append(raw)
        y.append(row.label)
    return x, y


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 8000, sample_bytes: int = 48 << 20, longest: int = 128 << 10, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    The network learns from a bounded sample of labels (``sample_rows`` texts of up to ``longest`` bytes each,
    ``sample_bytes`` in all); it reads texts only. Every text is scored whole, however long, in runs of chunks.
    A null text is scored as an empty one; a null id is held_out null. Repeated rows give repeated results,
    an empty table none. Without labels every score is 0.5, with labels of one kind all are near that one.
    Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = spark.sparkContext.broadcast(train(*training_rows(docs, labels, sample_rows, sample_bytes, longest), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [net.value.scores(s.data, s.offsets) for s in slabs(batch.column(1), RUN_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*score, np.zeros(0)]))], names=["doc_id", "score"])

    held_out = crc32_of(F.col("doc_id")) % 4 == 2
    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 8000, sample_bytes: int = 48 << 20, longest: int = 128 << 10, **options
) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    Scored in the same pass that carries the rows, so repeated or null ids need no join; rules as in
    ``quality_scores``. Where the labels are not of both kinds nothing can be told apart, and every document stays.
    An empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = training_rows(texts, labels, sample_rows, sample_bytes, longest)
    if len(set(sample[1])) < 2:
        return docs
    net = spark.sparkContext.broadcast(train(*sample, **options))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slabs(batch.column(at), RUN_BYTES):
                yield batch.slice(s.first, s.rows).filter(pa.array(net.value.scores(s.data, s.offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)
