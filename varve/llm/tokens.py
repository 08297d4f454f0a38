"""Token counts by two tiers of look-up, without a shuffle of the pieces between words.

The tokenizer first cuts a text into pieces (a word with its leading blank, digits, marks, blanks), then
merges bytes inside each piece, so the count of a text is the sum over its pieces. Tier one is a broadcast
table of the counts of frequent pieces, learned from a bounded sample of texts; it only saves time, the
counts never depend on it. Tier two encodes a piece that is not in the table once and keeps the count in
the worker. No piece leaves its task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.ship import ship

#: Characters on which the piece pattern below and the library's own are known to agree (tests/llm checks
#: every code point of these ranges). A text with any other character is encoded whole by the library.
AGREED = r"\x00-՗ՙ-֊֐-࡟ऀ-౛ഀ-⁰₠-⿿　-ꒌ가-힣豈-﫿︀-�\U0001F300-\U0001FAFF"

_CACHE_PIECES = 1_000_000
_state: dict[str, tuple] = {}
_cache: dict[tuple[str, str], int] = {}


def _tools(path: str):
    if path not in _state:
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        _state[path] = tokenizer, cut, regex.compile(public_tokenizers.PATTERN), regex.compile(f"[^{AGREED}]")
    return _state[path]


def _pieces(text: str, path: str) -> tuple[list[str], int] | None:
    """Pieces and the number of special strings in a text; None if only the library can cut it."""
    _, cut, pattern, odd = _tools(path)
    if not text.isascii() and odd.search(text):
        return None
    if cut is None or not cut.search(text):
        return pattern.findall(text), 0
    parts = cut.split(text)
    return [p for part in parts for p in pattern.findall(part)], len(parts) - 1


def count_tokens(texts: Iterable[str | None], path: str, table: dict[str, int]) -> list[int]:
    """Tokens of each text as the library counts them without begin, end or added tokens; null counts as empty."""
    tokenizer = _tools(path)[0]
    out: list[int | None] = []
    waiting: list[tuple[int, list[str]]] = []
    new: dict[str, None] = {}
    whole: list[tuple[int, str]] = []
    known = _cache.setdefault(path, {})
    for i, text in enumerate(texts):
        if not text:
            out.append(0)
            continue
        cut = _pieces(text, path)
        if cut is None:
            whole.append((i, text))
            out.append(None)
            continue
        pieces, total = cut
        missing = []
        for piece, n in zip(pieces, map(table.get, pieces)):
            if n is None:
                n = known.get(piece)
                if n is None:
                    missing.append(piece)
                    new[piece] = None
                    continue
            total += n
        out.append(total)
        if missing:
            waiting.append((i, missing))
    if new:
        if len(known) + len(new) > _CACHE_PIECES:
            known.clear()
        fresh = list(new)
        lengths = dict(zip(fresh, (len(e) for e in tokenizer.encode_batch_fast(fresh, add_special_tokens=False))))
        for i, missing in waiting:
            out[i] += sum(map(lengths.__getitem__, missing))
        known.update(lengths)
    for i, text in whole:
        out[i] = len(tokenizer.encode(text, add_special_tokens=False))
    return out


def frequent_pieces(docs: DataFrame, path: str, sample_texts: int = 2000, longest: int = 65_536, entries: int = 65_536) -> dict[str, int]:
    """Counts of the most frequent pieces of a hash-chosen sample: at most ``sample_texts`` texts of ``longest`` characters."""
    total = docs.count()
    if not total:
        return {}
    share = min(1.0, sample_texts / total)
    chosen = docs.where((F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1_000_000)) < int(share * 1_000_000)) & (F.length("text") <= longest))
    counts: Counter[str] = Counter()
    for (text,) in chosen.select("text").limit(2 * sample_texts).toLocalIterator():
        cut = _pieces(text, path)
        if cut is not None:
            counts.update(cut[0])
    top = [p for p, n in counts.most_common(entries) if n > 1]
    return dict(zip(top, (len(e) for e in _tools(path)[0].encode_batch_fast(top, add_special_tokens=False)))) if top else {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, group: int = 256) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts count 0. Special strings in a text count as the library's default does: one token
    each. Repeated rows give repeated results; an empty table gives none; other columns are ignored.
    ``tokenizer_path`` must exist on every machine; a text of any length is counted whole.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(2), []
            for k in range(0, len(texts), group):
                counts += count_tokens(texts.slice(k, group).to_pylist(), tokenizer_path, table.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
