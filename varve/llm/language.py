"""Language of a text by string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams of 1 to 3 bytes that both hold,
divided by the root of their own counts. Landmark texts (Nystroem) turn it into features on which one ridge
regression per language is fitted; a text is scored by the product of its presence row with the landmarks'
presence rows, then with the fitted coefficients, for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varve.llm.columns import crc32_of
from varve.llm.ship import ship
from varve.llm.textbytes import IS_SPACE, LOWER, Slab, slabs
from varve.sources.shared import written

UNKNOWN = "und"
#: Cells of the presence rows that are held at once.
GROUP_CELLS = 128 << 20
#: Landmarks that every language has at least, however many languages there are.
LEAST_LANDMARKS = 2


@dataclass
class Grams:
    """Presence of n-grams over the symbols seen in the landmarks; symbol 0 is any other byte.

    ``symbol`` maps a byte, ``column`` an n-gram's code to its column among the landmarks' n-grams, or -1.
    """

    symbol: np.ndarray
    size: int
    column: np.ndarray
    columns: int

    @classmethod
    def of(cls, data: np.ndarray) -> Grams:
        symbol = np.zeros(256, dtype=np.int32)
        used = np.unique(plain(data))
        symbol[used] = np.arange(1, len(used) + 1)
        return cls(symbol, len(used) + 1, np.zeros(0, dtype=np.int32), 0)

    @property
    def codes(self) -> int:
        return self.size + self.size**2 + self.size**3

    def presence(self, slab: Slab, first: int, last: int) -> np.ndarray:
        """One row of 0 and 1 per text first..last over all codes."""
        n = self.size
        low = self.symbol[plain(slab.data[slab.offsets[first] : slab.offsets[last]])]
        bounds = slab.offsets[first : last + 1] - slab.offsets[first]
        seen = np.zeros((last - first, self.codes), dtype=np.uint8)
        flat, left = seen.reshape(-1), np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(low))
        row = np.repeat(np.arange(last - first, dtype=np.int64) * self.codes, np.diff(bounds))
        flat[row + low] = 1
        two = low[:-1] * n + low[1:]
        flat[(row[:-1] + n + two)[left[:-1] > 1]] = 1
        three = two[:-1] * n + low[2:]
        flat[(row[:-2] + n + n * n + three)[left[:-2] > 2]] = 1
        return seen


def plain(data: np.ndarray) -> np.ndarray:
    """Lower case and one kind of blank."""
    low = LOWER[data]
    return np.where(IS_SPACE[low], np.uint8(0x20), low)


@dataclass
class Kernel:
    """A fitted classifier: landmarks' presence rows, each divided by its norm, and coefficients per language."""

    grams: Grams
    columns: np.ndarray
    landmarks: np.ndarray
    coefficients: np.ndarray
    offset: np.ndarray
    languages: list[str]

    def rows(self, slab: Slab) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Presence over the landmarks' n-grams, and the root of each text's own count."""
        group = max(1, min(64, GROUP_CELLS // self.grams.codes))
        for first in range(0, slab.rows, group):
            seen = self.grams.presence(slab, first, min(first + group, slab.rows))
            yield seen[:, self.columns].astype(np.float32), np.sqrt(np.maximum(seen.sum(axis=1, dtype=np.float32), 1))

    def kernel(self, slab: Slab) -> np.ndarray:
        return np.concatenate([(x @ self.landmarks) / norm[:, None] for x, norm in self.rows(slab)])

    def predict(self, slab: Slab) -> tuple[np.ndarray, np.ndarray]:
        """The best language's position for each text and its share of a softmax over all of them."""
        value = self.kernel(slab) @ self.coefficients + self.offset
        weight = np.exp(4.0 * (value - value.max(axis=1, keepdims=True)).astype(np.float64))
        return value.argmax(axis=1), weight.max(axis=1) / weight.sum(axis=1)


def fit(texts: list[str], languages: list[str], landmarks: int = 160, ridge: float = 1e-3) -> Kernel | None:
    """Landmarks are the first texts of each language in turn, at least LEAST_LANDMARKS of each; the order of ``texts`` decides. None without texts."""
    names = sorted(set(languages))
    if not names:
        return None
    by_language = {n: [i for i, x in enumerate(languages) if x == n] for n in names}
    chosen = [by_language[n][k] for k in range(landmarks) for n in names if k < len(by_language[n])][: max(landmarks, LEAST_LANDMARKS * len(names))]
    marks = pa.array([texts[i] for i in chosen], pa.large_string())
    data = np.concatenate([s.data for s in slabs(marks)])
    grams = Grams.of(data)
    # one landmark's row at a time: only the codes that it holds are kept
    held = [np.flatnonzero(grams.presence(s, k, k + 1)[0]) for s in slabs(marks) for k in range(s.rows)]
    columns = np.unique(np.concatenate(held))
    rows = np.zeros((len(columns), len(held)), dtype=np.float32)
    for k, codes in enumerate(held):
        rows[np.searchsorted(columns, codes), k] = 1 / np.sqrt(max(len(codes), 1))
    model = Kernel(grams, columns, rows, np.zeros(0), np.zeros(0), names)
    among = (model.landmarks.T @ model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([model.kernel(s) for s in slabs(pa.array(texts, pa.large_string()))]).astype(np.float64) @ root
    wanted = np.where(np.asarray(languages)[:, None] == np.asarray(names), 1.0, -1.0)
    centre, mean = features.mean(axis=0), wanted.mean(axis=0)
    x = features - centre
    beta = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ (wanted - mean))
    model.coefficients = (root @ beta).astype(np.float32)
    model.offset = (mean - centre @ beta).astype(np.float32)
    return model


def training_rows(docs: DataFrame, per_language: int, longest: int) -> tuple[list[str], list[str]]:
    """The first rows of each language in hash order, of those with crc32(doc_id) mod 5 not 0 and at most ``longest`` characters."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").where((crc32_of(F.col("doc_id")) % 5 != 0) & (F.length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    # ids are ranked without their texts, which are fetched for the few that are chosen
    usable = usable.select("doc_id", "lang", "text", F.xxhash64("text").alias("print"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "print")
    ranked = usable.select("doc_id", "lang", "print").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    ranked = written(ranked.select(F.col("doc_id").alias("of"), F.col("lang").alias("of_lang"), F.col("print").alias("of_print"), "nth"), "language-sample")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("lang") == F.col("of_lang")) & (F.col("print") == F.col("of_print"))
    fetched = usable.join(ranked, same).dropDuplicates(["nth", "lang"]).select("nth", "lang", "text")
    chosen = sorted(fetched.toLocalIterator())
    return [r.text for r in chosen], [r.lang for r in chosen]


def languages(docs: DataFrame, per_language: int = 400, longest: int = 65_536, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    Learns from a bounded sample (``per_language`` texts of up to ``longest`` characters for each language; the sample
    and the landmarks grow with the number of languages alone). Texts of any length are scored whole. Predicts from the whole text alone; a null text or one without a letter is ``und`` with score 0, and so
    is every text when there is nothing to learn from. A null id is held_out null. Repeated rows give repeated
    results; columns other than doc_id, text and lang are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"))])
    model = spark.sparkContext.broadcast(fit(*training_rows(docs, per_language, longest), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = [], []
            for slab in slabs(batch.column(1)):
                if model.value is None:
                    names += [UNKNOWN] * slab.rows
                    score.append(np.zeros(slab.rows))
                else:
                    best, share = model.value.predict(slab)
                    names += [model.value.languages[k] for k in best]
                    score.append(share)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.concatenate([*score, np.zeros(0)]))], names=["doc_id", "lettered", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, "doc_id long, lettered boolean, lang_pred string, score double")
    return found.select(
        "doc_id",
        (crc32_of(F.col("doc_id")) % 5 == 0).alias("held_out"),
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
    )
