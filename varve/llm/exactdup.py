"""Exact duplicates by an exchange of compressed fingerprints; only the texts of suspects are shuffled.

1. Every packet of rows (a run of one task's rows, about 4 MB) is written once, in a bucket that a few packets of
   the task share, with a fingerprint of each normalised text.
2. A packet sends its distinct fingerprints, sorted and Golomb-coded, to the owners of the hash ranges they fall in.
3. An owner decodes the lists of its range and answers each packet by a bitmap: which of its fingerprints other
   packets hold as well. The answers are small and travel to the packets' buckets, and so do the marks that the
   fingerprints get there; the texts stay in place.
   Together with those that a packet holds twice itself these are the suspects.
4. The texts of suspects, and no others, are grouped byte by byte, combined before the shuffle, and the answer
   returns to the packets, so that no group of copies is ever gathered: a packet holds at most ``packet_rows`` of them.

A fingerprint is short on purpose: two different texts that share one are suspects, and the bytes tell them apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.ship import ship
from varve.sources.shared import bucketed, discard, written

#: Bits of a fingerprint: a multiple of four, taken from the front of the text's sha256.
BITS = 48
PACKET_ROWS, PACKET_BYTES = 1 << 16, 4 << 20
#: Fingerprints of one owner: its task holds about 40 bytes for each.
OWNER_ROWS = 1 << 20
#: Spark's own limit is 100,000.
MOST_BUCKETS = 50_000
#: Packets of a lot, as a power of two.
LOT_BITS = 3
#: Row groups of a packet or two, however well they compress: a reader holds a whole row group, a writer one that grows.
ROW_GROUPS = {"parquet.block.row.count.limit": 2, "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def golomb_encode(values: np.ndarray, universe: int) -> tuple[int, bytes]:
    """Ascending distinct numbers in [0, universe) as a Golomb code of their gaps: (shift, payload).

    The divisor is the power of two next to 0.69 times the mean gap. All quotients come first, in unary,
    then all remainders of ``shift`` bits, so that both directions are array operations.
    """
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=-1) - 1
    shift = max(0, round(math.log2(max(1.0, 0.69 * universe / len(values)))))
    ends = np.cumsum((gaps >> shift) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(shift - 1, -1, -1)) & 1).astype(np.uint8) if shift else np.zeros((0, 0), np.uint8)
    return shift, np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def golomb_decode(n: int, shift: int, payload: bytes) -> np.ndarray:
    """The numbers that ``golomb_encode`` took."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8))
    ends = np.flatnonzero(bits)[:n]  # the n-th one ends the quotients
    gaps = np.diff(ends, prepend=-1) - 1
    if shift:
        at = int(ends[-1]) + 1
        rest = bits[at : at + n * shift].reshape(n, shift).astype(np.int64) @ (1 << np.arange(shift - 1, -1, -1, dtype=np.int64))
        gaps = (gaps << shift) + rest
    return np.cumsum(gaps + 1) - 1


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def fingerprint(sha: Column, bits: int) -> Column:
    return F.conv(F.substring(sha, 1, bits // 4), 16, 10).cast("long")


def packed(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in packets of up to ``rows`` rows, closed by the row that brings them to ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    n = weight = 0
    for batch in batches:
        ends, at = np.cumsum(row_bytes(batch)), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, before + size - weight)) + 1, at + rows - n, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            n, weight, at = n + stop - at, weight + int(ends[stop - 1]) - before, stop
            if n == rows or weight >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, weight = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row: texts by their length, other columns as eight."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        is_text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
        total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if is_text else 8
    return total


def packets(docs: DataFrame, bits: int, rows: int, size: int) -> DataFrame:
    """lot, packet, ids, shas, prints, bodies: the rows of every packet in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for nth, batch in enumerate(packed(batches, rows, size)):
            of = lambda column: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), column)
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | nth]), *[of(batch.column(i)) for i in range(4)]], names=["packet", "ids", "shas", "prints", "bodies"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), normalised(F.col("text")).alias("body"))
    texts = texts.select("id", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "body")
    rows_of = texts.select("id", "sha", fingerprint(F.col("sha"), bits).alias("print"), "body")
    of_task = rows_of.mapInArrow(run, "packet long, ids array<long>, shas array<string>, prints array<long>, bodies array<string>")
    return of_task.select(lot().alias("lot"), "*")


def lot() -> Column:
    """The number of the run of packets, of one task, that lie in one bucket: else each packet would be a file."""
    return F.shiftright("packet", LOT_BITS)


def owner_limits(owners: int, bits: int) -> np.ndarray:
    """Where the owners' ranges begin, and the end of the last one."""
    return np.array([(i << bits) // owners for i in range(owners + 1)], dtype=np.int64)


def messages(table: DataFrame, owners: int, bits: int) -> DataFrame:
    """owner, packet, n, shift, payload: each packet's distinct fingerprints, coded for the owner of their range."""
    limits = owner_limits(owners, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packet, prints in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(prints.values.to_numpy())
                at = np.searchsorted(own, limits)
                out = []
                for owner in np.flatnonzero(np.diff(at)):
                    part = own[at[owner] : at[owner + 1]] - limits[owner]
                    out.append((int(owner), packet, len(part), *golomb_encode(part, int(limits[owner + 1] - limits[owner]))))
                yield pa.RecordBatch.from_pylist([dict(zip(MESSAGE.names, row)) for row in out], schema=MESSAGE)

    return table.select("packet", "prints").mapInArrow(run, "owner int, packet long, n int, shift int, payload binary")


MESSAGE = pa.schema([("owner", pa.int32()), ("packet", pa.int64()), ("n", pa.int32()), ("shift", pa.int32()), ("payload", pa.binary())])
REPLY = pa.schema([("packet", pa.int64()), ("owner", pa.int32()), ("bitmap", pa.binary())])


def replies(sent: DataFrame, owners: int) -> DataFrame:
    """packet, owner, bitmap: one bit for each fingerprint of a message, set where another packet sent it too.

    A message without a set bit gets no reply.
    """

    def answer(batch: pa.Table) -> pa.RecordBatch:
        lists = [golomb_decode(r["n"], r["shift"], r["payload"]) for r in batch.select(["n", "shift", "payload"]).to_pylist()]
        values, inverse, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared, at, out = times[inverse] > 1, 0, []
        for packet, own in zip(batch.column("packet").to_pylist(), lists):
            bits = shared[at : at + len(own)]
            at += len(own)
            if bits.any():
                out.append({"packet": packet, "owner": batch.column("owner")[0].as_py(), "bitmap": np.packbits(bits).tobytes()})
        return pa.RecordBatch.from_pylist(out, schema=REPLY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by owner: one owner's messages are held at a time
            owner = batch.column("owner").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if held and high > low and held[-1].column("owner")[0].as_py() != owner[low]:
                    yield answer(pa.Table.from_batches(held))
                    held = []
                if high > low:
                    held.append(batch.slice(low, high - low))
        if held:
            yield answer(pa.Table.from_batches(held))

    return sent.repartition(owners, "owner").sortWithinPartitions("owner", "packet").mapInArrow(run, "packet long, owner int, bitmap binary")


def marked(table: DataFrame, answers: DataFrame, owners: int, bits: int, buckets: int) -> DataFrame:
    """place, packet, doc_id, print, sha, suspect, body of every document: the packets read what the owners answered.

    The body is there for suspects only. Python sees the fingerprints and returns a mark for each; texts stay in the JVM here.
    """
    limits = owner_limits(owners, bits)
    per_lot = lambda df, out: df.repartition(buckets, "lot").groupBy("lot").agg(out).hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packet, prints = batch.column("packet")[i].as_py(), batch.column("prints")[i].values.to_numpy()
                own, inverse, times = np.unique(prints, return_inverse=True, return_counts=True)
                suspect, at = times > 1, np.searchsorted(own, limits)
                for reply in batch.column("answers")[i].as_py() or []:
                    if reply["packet"] == packet:
                        low, high = at[reply["owner"]], at[reply["owner"] + 1]
                        suspect[low:high] |= np.unpackbits(np.frombuffer(reply["bitmap"], dtype=np.uint8), count=high - low).astype(bool)
                marks = pa.ListArray.from_arrays(pa.array([0, len(prints)], pa.int32()), pa.array(suspect[inverse]))
                yield pa.RecordBatch.from_arrays([batch.column("lot").slice(i, 1), batch.column("packet").slice(i, 1), marks], names=["lot", "packet", "suspects"])

    answered = per_lot(answers.withColumn("lot", lot()), F.collect_list(F.struct("packet", "owner", "bitmap")).alias("answers"))
    prints = table.select("lot", "packet", "prints").join(answered, "lot", "left").select("lot", "packet", "prints", "answers")
    marks = prints.mapInArrow(run, "lot long, packet long, suspects array<boolean>")
    joined = table.join(per_lot(marks, F.map_from_entries(F.collect_list(F.struct("packet", "suspects"))).alias("marks")), "lot")
    rows = F.arrays_zip("ids", "prints", "shas", F.element_at("marks", F.col("packet")).alias("suspects"), "bodies")
    each = joined.select("packet", F.posexplode(rows).alias("place", "row"))
    body = F.when(F.col("row.suspects"), F.col("row.bodies"))
    named = {"doc_id": "ids", "print": "prints", "sha": "shas", "suspect": "suspects"}
    return each.select(F.col("place").cast("long").alias("place"), "packet", *[F.col(f"row.{of}").alias(name) for name, of in named.items()], body.alias("body"))


def exact_duplicates(
    docs: DataFrame, bits: int = BITS, packet_rows: int = PACKET_ROWS, packet_bytes: int = PACKET_BYTES, owner_rows: int = OWNER_ROWS, least_owners: int = 16
) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, A-Z in lower case; null counts as empty. Of equal texts the row with the
    largest doc_id stays (of rows that repeat it one, of a group without any id one, with keep_id null).
    ``text_sha256`` is that of the normalised text. An empty table gives none; other columns are ignored, whatever
    their names. A task holds a packet, or one longer text. The result does not depend on ``bits`` or the sizes of
    packets and owners.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    buckets = min(max(docs.rdd.getNumPartitions(), 2), MOST_BUCKETS)
    table = bucketed(packets(docs, bits, packet_rows, packet_bytes), "dedup-packets", "lot", buckets, **ROW_GROUPS)
    total = table.agg(F.sum(F.size("prints"))).first()[0] or 0
    owners = max(least_owners, -(-total // owner_rows))
    answers = written(replies(messages(table, owners, bits), owners), "dedup-answers")
    rows = written(marked(table, answers, owners, bits, buckets), "dedup-rows")
    discard(table, answers)
    suspects = rows.where("suspect")
    # one row per task and distinct text enters the shuffle
    groups = suspects.groupBy("print", "sha", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.drop("body"), "dedup-groups")
    suspects = suspects.drop("body")
    # what each packet holds of each group: a hot text has one row per packet here
    top = F.max(F.struct("doc_id", (-F.col("place")).alias("back"))).alias("top")
    held = suspects.groupBy("packet", "print", "sha").agg(top).join(groups, ["print", "sha"])
    holds = F.col("top.doc_id").eqNullSafe(F.col("keep_id"))
    home = F.min(F.when(holds, F.col("packet"))).over(Window.partitionBy("print", "sha"))
    told = held.select("packet", "print", "sha", "keep_id", "group_size", F.when(home == F.col("packet"), -F.col("top.back")).alias("stays"))
    told = written(told, "dedup-told")
    discard(groups)
    copies = suspects.join(told, ["packet", "print", "sha"])
    columns = lambda df, keep, size, kept: df.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
    alone = columns(rows.where("NOT suspect"), F.col("doc_id"), F.lit(1).cast("long"), F.lit(True))
    return alone.unionByName(columns(copies, F.col("keep_id"), F.col("group_size"), F.coalesce(F.col("place") == F.col("stays"), F.lit(False))))


#: The same rows in DuckDB; ids do not repeat in the tables it is held against.
DEDUP_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM n JOIN g USING (body)
"""
