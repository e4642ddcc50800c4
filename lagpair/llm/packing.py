"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` ids. How the pieces fill
sequences is planned over counts: lengths are taken in descending order, and all
pieces of one length go, run by run, to the open sequences whose free space fits
them most closely, and then to new ones. The plan is a list of slots for ranges of
ranks of a length. It depends on at most ``capacity`` lengths, never on
documents, is bounded in size, and is planned on the driver.
Documents then take their slots by their rank within their length.

Ranks are counted in two steps, so that a length that a third of all pieces have
is never sorted by one task: pieces are numbered within (length, bucket), a
bucket being a range of hashes, and the buckets' counts give each bucket's first
rank.

Edge cases: a null or empty text is the end id alone. Rows that repeat a doc_id
are each packed; their pieces are ranked by checksum too. An empty table has no
piece. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagpair.llm import bpe
from lagpair.llm.common import small_batches, stored, text_rows

CAPACITY = 4096
#: Ranks are counted in so many hash ranges at least, and in more for a length of more pieces than this many times so many.
BUCKETS = 64
BUCKET_PIECES = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, spaced: bool, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids = batch.column("doc_id").cast(pa.int64())
        for a, b, ids, bounds in bpe.encoded(batch.column("text"), tokenizer, spaced):
            row, piece, start, length, crc = [], [], [], [], []
            end = np.array([end_id], dtype="<u4").tobytes()
            raw = memoryview(ids.astype("<u4").tobytes())
            for r, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                n = y - x + 1
                for k, s in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - s)
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(size)
                    last = s + size == n
                    c = zlib.crc32(raw[4 * (x + s) : 4 * (x + s + size - last)])
                    crc.append(zlib.crc32(end, c) if last else c)
            yield pa.RecordBatch.from_arrays(
                [doc_ids.slice(a, b - a).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def pieces(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """Lengths and checksums of the documents' pieces: only longer documents are cut."""
    small_batches(docs.sparkSession)
    return text_rows(docs, "doc_id", "text").mapInArrow(lambda b: _cut(b, tokenizer, spaced, end_id, capacity), PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots as rows (length, first rank, end rank, first sequence, offset, copies): the k-th piece of a slot goes to
    sequence ``first + k // copies``, at ``offset + k % copies * length``.

    Open sequences are kept as runs of consecutive numbers by their free space. After the tightest sequence has taken a
    piece it is the tightest still, so best fit fills it with as many pieces of the length as fit before the next: these are
    its copies. A length opens one run and splits two at most, so there are three runs a length at most. What a run has free
    after its turn is less than half of what it had, so a run has log2(capacity) turns at most. The plan therefore has no
    more than 3 * capacity * log2(capacity) rows of 48 bytes (7 MB for 4096), however many documents there are.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces = np.zeros(capacity + 1, dtype=bool)
    rows: list[tuple[int, ...]] = []
    opened = 0

    def release(space: int, first: int, count: int) -> None:
        if space and count:
            free.setdefault(space, []).append((first, count))
            spaces[space] = True

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fitting = np.flatnonzero(spaces[length:])
            if len(fitting):
                space = int(fitting[0]) + length
                first, count = free[space].pop()
                spaces[space] = bool(free[space])
            else:
                space, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            copies = space // length
            filled = min(count, left // copies)
            if filled:
                rows.append((length, rank, rank + filled * copies, first, capacity - space, copies))
                release(space - copies * length, first, filled)
                rank, left = rank + filled * copies, left - filled * copies
            if filled < count and left:  # fewer pieces are left than the next sequence could take
                rows.append((length, rank, rank + left, first + filled, capacity - space, copies))
                release(space - left * length, first + filled, 1)
                filled, left = filled + 1, 0
            release(space, first + filled, count - filled)
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def ranked(cut: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``rank``, from 0 within each length."""
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return keyed.withColumn("within", F.row_number().over(inside) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first_rank") + F.col("within")).drop("bucket", "within", "first_rank")


def _placed(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = (slots[:, 0].astype(np.uint64) << np.uint64(48)) + slots[:, 1].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, slots = key[order], slots[order]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(key, (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), side="right") - 1
        slot = slots[at]
        if len(slot) and not ((slot[:, 0] == length) & (slot[:, 1] <= rank) & (rank < slot[:, 2])).all():
            raise ValueError("a piece has no slot in the plan")
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(slot[:, 3] + (rank - slot[:, 1]) // slot[:, 5]), pa.array(slot[:, 4] + (rank - slot[:, 1]) % slot[:, 5] * length)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: its document, place there, checksum, sequence and offset in the sequence."""
    cut = stored(pieces(docs, tokenizer, end_id, spaced, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shipped = cut.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    buckets = max(BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_PIECES))
    return ranked(cut, buckets).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda b: _placed(b, shipped.value), PIECES + ", sequence_id long, offset long")
