"""License scans: winnowed fingerprints of templates find candidates, banded alignment measures them.

Texts are reduced to their letters and digits in lower case. A template's fingerprints (the smallest of each
four successive hashes of ten characters) are kept in an inverted index; a place where a text shares one is a
candidate for the template at that offset. The template is then aligned with the text around it inside a band
of shifts. Its coverage is the number of characters matched over the longer of template and matched span, so what
the text leaves out and what it puts in both count; it is reported with the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.license_texts import TEMPLATES as WORDINGS
from varve.llm.ship import ship
from varve.llm.textbytes import LOWER, mix, slabs

GRAM, WINDOW = 10, 4
#: Shifts of the alignment to either side, in characters, and in parts of the template's length.
BAND, BAND_SHARE = 12, 8
TABLE = 1 << 16

#: The first wording of each license.
TEMPLATES = {name: wordings[0] for name, wordings in WORDINGS.items()}

#: Templates of fewer letters and digits must match word by word: words of up to NAME letters or digits in full, as one
#: letter more or less there names another license, longer ones up to one letter. A place must show that share of the
#: template's fingerprints to be compared so.
SHORT, NAME, SPELLED_SUPPORT = 48, 4, 0.2
#: Share of a template's fingerprints that a place must show to be aligned with it, by the template's length, and to be
#: reported in part. A long text that still covers nine tenths keeps far more; a line of it has a template of its own.
SUPPORT, LONG, LONG_SUPPORT, PARTIAL_SUPPORT = 0.05, 200, 0.2, 0.25

IS_SOLID = np.zeros(256, dtype=bool)
IS_SOLID[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def solid(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters, digits and other non-ASCII bytes in lower case, and their places."""
    low = LOWER[data]
    at = np.flatnonzero(IS_SOLID[low])
    return low[at], at


def words_of(chars: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Runs of letters and digits that stand without a gap."""
    return [w.tobytes() for w in np.split(chars, np.flatnonzero(np.diff(at) != 1) + 1)]


def winnowed(chars: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints; no gram spans two owners, a short owner keeps its smallest gram."""
    n = len(chars) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        hashes = hashes * np.uint64(0x100000001B3) + chars[j : j + n]
    hashes = mix(hashes)
    hashes[owner[:n] != owner[GRAM - 1 :]] = ~np.uint64(0)
    padded = np.r_[hashes, np.full(WINDOW - 1, ~np.uint64(0))]
    least = padded[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, padded[j : j + n], out=least)
    chosen = np.zeros(n, dtype=bool)
    for j in range(WINDOW):  # a hash is kept if it is the least of any window that holds it
        chosen[j:] |= hashes[j:] == least[: n - j]
    at = np.flatnonzero(chosen & (hashes != ~np.uint64(0)))
    return at, hashes[at]


@dataclass
class Library:
    """Templates (license and wording) and the inverted index of their fingerprints: sorted hashes with template and place."""

    names: list[str]
    chars: list[np.ndarray]
    words: list[list[bytes]]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray
    prints: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, templates: dict[str, str | list[str]]) -> Library:
        wordings = [(name, w) for name in sorted(templates) for w in ([templates[name]] if isinstance(templates[name], str) else templates[name])]
        solids = [(name, *solid(np.frombuffer(w.encode(), dtype=np.uint8))) for name, w in wordings]
        solids = [x for x in solids if len(x[1]) >= GRAM]
        names, chars, words = [n for n, _, _ in solids], [c for _, c, _ in solids], [words_of(c, at) for _, c, at in solids]
        found = [winnowed(c, np.zeros(len(c), dtype=np.int64)) for c in chars]
        hashes = np.concatenate([*(h for _, h in found), np.zeros(0, dtype=np.uint64)])
        template = np.repeat(np.arange(len(names)), [len(h) for _, h in found])
        place = np.concatenate([*(a for a, _ in found), np.zeros(0, dtype=np.int64)])
        order = np.argsort(hashes, kind="stable")
        filter_ = np.zeros(TABLE, dtype=bool)
        filter_[hashes & np.uint64(TABLE - 1)] = True
        return cls(names, chars, words, hashes[order], template[order], place[order], np.array([len(h) for _, h in found]), filter_)

    def candidates(self, at: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(template, place in the text where it would begin, share of its fingerprints there), near places of a template taken together."""
        passed = self.filter[hashes & np.uint64(TABLE - 1)]
        at, hashes = at[passed], hashes[passed]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        entry = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        template, begin, place = self.template[entry], np.repeat(at, n) - self.place[entry], self.place[entry]
        order = np.lexsort((begin, template))
        group: list[tuple[int, int, int]] = []
        for t, b, p in zip(template[order].tolist(), begin[order].tolist(), place[order].tolist()):
            if group and (t != group[0][0] or b - group[0][1] > self.band(t)):
                yield from self._candidate(group)
                group = []
            group.append((t, b, p))
        if group:
            yield from self._candidate(group)

    def _candidate(self, group: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, float]]:
        t, support = group[0][0], len({p for _, _, p in group}) / int(self.prints[group[0][0]])
        if len(self.chars[t]) < SHORT:  # these match in full or not at all: every beginning is looked at
            yield from ((t, b, support) for b in sorted({b for _, b, _ in group}))
            return
        if support >= (SUPPORT if len(self.chars[t]) < LONG else LONG_SUPPORT):
            yield t, sorted(b for _, b, _ in group)[len(group) // 2], support

    def band(self, template: int) -> int:
        return max(BAND, len(self.chars[template]) // BAND_SHARE)


def align(template: np.ndarray, text: np.ndarray, begin: int, band: int) -> tuple[int, int, int]:
    """Most template characters matched in order within ``band`` shifts of ``begin``; first and last text place matched.

    A longest common subsequence along the diagonals of the band, and the shortest span among the best.
    """
    width = 2 * band + 1
    shift = np.arange(width) - band
    best = np.zeros(width, dtype=np.int64)
    first = np.full(width, -1, dtype=np.int64)  # text place of the first match of each cell's best path
    last = np.full(width, -1, dtype=np.int64)
    for i, c in enumerate(template):
        at = begin + i + shift
        inside = (at >= 0) & (at < len(text))
        match = inside & (text[np.clip(at, 0, len(text) - 1)] == c)
        # without the character: the cell above has one shift more
        up, up_first, up_last = np.r_[best[1:], 0], np.r_[first[1:], -1], np.r_[last[1:], -1]
        take = match & (best + 1 >= up)
        new = np.where(take, best + 1, up)
        new_first = np.where(take, np.where(best == 0, at, first), up_first)
        new_last = np.where(take, at, up_last)
        # skipping text characters moves along the row: carry the best of all smaller shifts
        lead = np.maximum.accumulate(new)
        held = np.maximum.accumulate(np.where(new == lead, np.arange(width), 0))
        best, first, last = new[held], new_first[held], new_last[held]
    k = int(best.argmax())
    return int(best[k]), int(first[k]), int(last[k])


def kept_of(word: bytes, other: bytes) -> int:
    """Letters that two spellings of a word share, one letter apart at most; 0 if they are different words."""
    if word == other:
        return len(word)
    if len(word) <= NAME or abs(len(word) - len(other)) > 1:
        return 0
    same = next((i for i, (x, y) in enumerate(zip(word, other)) if x != y), min(len(word), len(other)))
    if word[same + (len(word) >= len(other)) :] != other[same + (len(other) >= len(word)) :]:
        return 0
    return len(word) - (len(word) >= len(other))


def spelled(words: list[bytes], chars: np.ndarray, at: np.ndarray, begin: int) -> tuple[int, int, int]:
    """As ``align``, for the words of a short template that follow each other from a word near ``begin``; 0, 0, 0 if they do not."""
    low, total = max(begin - 3, 0), sum(map(len, words))
    near, places = chars[low : begin + total + len(words) + 3], at[low : begin + total + len(words) + 3]
    if not len(near):
        return 0, 0, 0
    starts = np.r_[0, np.flatnonzero(np.diff(places) != 1) + 1]
    found = words_of(near, places)
    best = (0, 0, 0)
    for k in range(min(7, len(found) - len(words) + 1)):
        first = low + int(starts[k])
        if first > begin + 3:
            break
        if k == 0 and first and at[first] == at[first - 1] + 1:  # not the beginning of a word
            continue
        kept = [kept_of(w, o) for w, o in zip(words, found[k : k + len(words)])]
        last = first + sum(map(len, found[k : k + len(words)])) - 1
        if all(kept) and sum(kept) > best[0] and not (last + 1 < len(at) and at[last + 1] == at[last] + 1):
            best = (sum(kept), first, last)
    return best


def matches(library: Library, texts: pa.Array, coverage: float, partial: float) -> Iterator[tuple[int, str, float, int, int]]:
    """(row, license, coverage, first byte, byte after the last) of each match; of overlapping ones the best."""
    for slab in slabs(texts):
        chars, at = solid(slab.data)
        row = np.searchsorted(slab.offsets, at, side="right") - 1
        bounds = np.searchsorted(row, np.arange(slab.rows + 1))
        places, hashes = winnowed(chars, row)
        found: dict[int, list] = {}
        for t, begin, support in library.candidates(places, hashes):
            pattern, band = library.chars[t], library.band(t)
            least = partial if len(pattern) >= SHORT and support >= PARTIAL_SUPPORT else coverage
            r = int(row[min(max(begin + len(pattern) // 2, 0), len(row) - 1)])
            for own in {r, int(row[max(begin, 0)]), int(row[min(max(begin + len(pattern) - 1, 0), len(row) - 1)])}:
                text, start = chars[bounds[own] : bounds[own + 1]], begin - int(bounds[own])
                if len(pattern) >= SHORT:
                    n, first, last = align(pattern, text, start, band)
                else:
                    whole = start >= 0 and np.array_equal(text[start : start + len(pattern)], pattern)
                    n, first, last = (len(pattern), start, start + len(pattern) - 1) if whole else (0, 0, 0)
                    if not whole and support >= SPELLED_SUPPORT:
                        n, first, last = spelled(library.words[t], text, at[bounds[own] : bounds[own + 1]], start)
                share = n / max(len(pattern), last - first + 1)
                if n and share >= least:
                    a, z = bounds[own] + first, bounds[own] + last
                    found.setdefault(own, []).append((share, n, library.names[t], int(at[a] - slab.offsets[own]), int(at[z] + 1 - slab.offsets[own])))
        for r in sorted(found):
            kept: list = []
            for m in sorted(set(found[r]), key=lambda m: (-m[0] * m[1], m[3], m[2])):
                if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
                    kept.append(m)
            for m in sorted(kept, key=lambda m: m[3]):
                yield slab.first + r, m[2], m[0], m[3], m[4]


def license_matches(docs: DataFrame, templates: dict[str, str | list[str]] | None = None, coverage: float = 0.9, partial: float = 0.5) -> DataFrame:
    """One row per license found: doc_id, license, coverage, complete, span_start, span_end (bytes of the UTF-8 text).

    ``templates`` (name to its wordings) go to all tasks; they are the caller's list, not data. Those under ten
    letters or digits are left out, those under 48 must match word by word, their longer words up to one letter. A match is complete from ``coverage`` on;
    longer templates of which a quarter of the fingerprints is there are also reported in part, from ``partial`` on.
    Where spans overlap, the match with the most characters, weighed by its coverage, stays. Null, empty and clean
    texts give no row; texts of any length are scanned whole; repeated rows give repeated results; other columns
    are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    library = spark.sparkContext.broadcast(Library.of(WORDINGS if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(batch.column(0)[r].as_py(), name, share, share >= coverage, a, z) for r, name, share, a, z in matches(library.value, batch.column(1), coverage, partial)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
            names = ["doc_id", "license", "coverage", "complete", "span_start", "span_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=names)

    return docs.mapInArrow(run, "doc_id long, license string, coverage double, complete boolean, span_start long, span_end long")
