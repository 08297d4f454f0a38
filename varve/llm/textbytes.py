"""Vectorised work on the UTF-8 bytes of a batch of texts: words, hashes and shingles without a loop over words.

A batch is an Arrow string array. Its bytes are one buffer, so numpy sees all texts of a slab at once.
A null text has no bytes and is treated as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the temporary arrays are about 40 times that.
SLAB_BYTES = 512 << 10

#: White space of the word definition [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX_1
    h ^= h >> np.uint64(27)
    h *= _MIX_2
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Slab:
    """Rows first..last of a batch with their bytes; offsets has one more entry than rows."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def slabs(texts: pa.Array, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """Whole texts in slabs of about ``limit`` bytes; a longer text is a slab of its own."""
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield Slab(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Word positions in a slab; words of row i are bounds[i]..bounds[i+1]."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(slab: Slab) -> Words:
    """All words [^\\x20\\x09-\\x0D]+ of a slab, A-Z in lower case."""
    low = LOWER[slab.data]
    solid = ~IS_SPACE[low]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = slab.offsets[(slab.offsets > 0) & (slab.offsets < len(low))]
    begin[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(begin)
    return Words(low, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, slab.offsets))


_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, kept per worker."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for k, base in enumerate((_ODD, inverse)):
            table = np.full(max(n, SLAB_BYTES + 1), base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes from running sums, then scrambled."""
    if not len(w.starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_tables(len(w.low) + 1)
    running = np.zeros(len(w.low) + 1, dtype=np.uint64)
    np.cumsum((w.low.astype(np.uint64) + np.uint64(1 + seed)) * power[: len(w.low)], out=running[1:])
    return mix((running[w.ends] - running[w.starts]) * inverse[w.starts])


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their bounds per row; a row with 1..size-1 words has one shingle of all."""
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.r_[0, np.cumsum(n)]
    if not out_bounds[-1]:
        return np.zeros(0, dtype=np.uint64), out_bounds
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(out_bounds[-1]) - out_bounds[row] + bounds[row]
    left = np.minimum(counts[row], size)  # words in this shingle
    acc = np.zeros(len(at), dtype=np.uint64)
    padded = np.r_[hashes, np.zeros(size, dtype=np.uint64)]
    for j in range(size):
        inside = left > j
        acc = np.where(inside, acc * _ODD + padded[at + j], acc)
    return mix(acc + left.astype(np.uint64)), out_bounds
