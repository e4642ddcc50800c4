"""Token ids on disk: one compressed wavelet matrix per shard.

A shard file holds the ids of consecutive documents as bit-planes, from the
highest bit down. In each plane the ids stand in the order in which the planes
above have put them, zeros before ones. A plane is stored in pages of
``PAGE_BITS`` bits, each compressed on its own, with the count of ones before
every page. Rank, select, access, counting and occurrence lookup for an id
decompress the pages that they touch and no others. As ids that share their
high bits stand together, the lower planes have long even runs: a file takes
less than the ids in 16 bits each would.

File: magic, a JSON header with its length, then the sections that the header
names with their offsets: document ids (as differences), document lengths, and
for every plane its pages, their lengths and the counts of ones before them.

Writing: documents are range-partitioned by doc_id; every task sorts its range,
encodes it and writes files of at most ``shard_tokens`` ids (a longer document
alone is a file of its own) to the shared folder, under names that a repeated
task cannot collide with. The manifest has the files of the tasks that
succeeded; what others left is never read.

Edge cases: a null or empty text has no id but the end id. Null doc_ids come
first. Documents that repeat a doc_id stand next to each other, ordered by
text. An empty table has no shard. An id that does not fit the planes is an
error; their number follows from the vocabulary. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagpair.llm import bpe
from lagpair.llm.common import small_batches, text_rows, work_path

MAGIC = b"WVMX0002"
#: Bits of a page, which is decompressed as a whole.
PAGE_BITS = 1 << 18
#: Ids of a shard, at most; some 20 bytes each are needed while it is built.
SHARD_TOKENS = 4 << 20

#: Shards that one task reads, one after the other, where there are more than cores.
SHARDS_A_TASK = 16

MANIFEST = "path string, part int, seq int, n_docs long, n_tokens long, first_doc long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _packed(data: bytes) -> bytes:
    """Compressed bytes, or the bytes themselves where that is no longer."""
    small = pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)
    return small if len(small) < len(data) else data


def _unpacked(data: bytes | memoryview, size: int) -> bytes:
    return bytes(data) if len(data) == size else pa.Codec("zstd").decompress(data, decompressed_size=size, asbytes=True)


class Plane:
    """``n`` bits in pages that are decompressed when they are first needed."""

    def __init__(self, n: int, pages: list[bytes | memoryview], ones: np.ndarray):
        self.n, self.pages, self.ones = n, pages, ones
        self._loaded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, bit: np.ndarray) -> Plane:
        packed = np.packbits(bit, bitorder="little")
        size = PAGE_BITS // 8
        packed = np.concatenate([packed, np.zeros(-len(packed) % size, np.uint8)])
        counts = np.bitwise_count(packed.view(np.uint64)).reshape(-1, PAGE_BITS // 64).sum(axis=1, dtype=np.int64)
        return cls(len(bit), [_packed(page.tobytes()) for page in packed.reshape(-1, size)], np.concatenate([[0], np.cumsum(counts)]))

    def bits(self, page: int) -> np.ndarray:
        """The bytes of a page, eight bits each."""
        return np.frombuffer(_unpacked(self.pages[page], PAGE_BITS // 8), np.uint8)

    def _page(self, page: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of 64 bits and the ones before each in its page."""
        if page not in self._loaded:
            words = self.bits(page).view(np.uint64)
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self._loaded[page] = words, np.concatenate([[0], counts[:-1]])
        return self._loaded[page]

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each position (0 at the end) and the ones before it."""
        page = at // PAGE_BITS
        bit, rank = np.zeros(len(at), np.uint32), self.ones[page].copy()
        for p in np.unique(page[page < len(self.pages)]).tolist():
            words, before = self._page(p)
            mine = np.flatnonzero(page == p)
            local = at[mine] % PAGE_BITS
            word, part = words[local >> 6], (local & 63).astype(np.uint64)
            bit[mine] = (word >> part) & np.uint64(1)
            rank[mine] += before[local >> 6] + np.bitwise_count(word & ((np.uint64(1) << part) - np.uint64(1)))
        return bit, rank

    def select(self, one: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) one or zero: its page by the counts, its place among the page's."""
        before = self.ones if one else np.arange(len(self.ones), dtype=np.int64) * PAGE_BITS - self.ones
        page = np.searchsorted(before, k, side="right") - 1
        out = np.zeros(len(k), np.int64)
        for p in np.unique(page).tolist():
            places = np.flatnonzero(np.unpackbits(self.bits(p), bitorder="little") == one)
            mine = page == p
            out[mine] = p * PAGE_BITS + places[k[mine] - before[p]]
        return out

    def all(self) -> np.ndarray:
        if not self.pages:
            return np.zeros(0, dtype=bool)
        return np.unpackbits(np.concatenate([self.bits(p) for p in range(len(self.pages))]), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    """Rank and select over a sequence of ids below ``2 ** bits``."""

    def __init__(self, n: int, bits: int, planes: list[Plane], zeros: list[int]):
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"id {ids.max()} has more than {bits} bits")
        kind = np.uint16 if bits <= 16 else np.uint32
        ids = ids.astype(kind)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (ids & kind(1 << level)) != 0
            planes.append(Plane.build(bit))
            low = ids[~bit]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[bit]])
        return cls(len(ids), bits, planes, zeros)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for plane, zeros in zip(self.planes, self.zeros):
            bit, ones = plane.look(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def _run(self, token: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ``token``s of the positions from ``low`` to ``high`` stand under the last plane."""
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            (_, a), (_, b) = plane.look(low), plane.look(high)
            low, high = (zeros + a, zeros + b) if token >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``token`` before each position."""
        at = np.asarray(at, np.int64)
        if token >> self.bits:
            return np.zeros_like(at)
        low, high = self._run(token, np.zeros_like(at), at)
        return high - low

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        a, b = self.rank(token, np.array([begin, self.n if end is None else end]))
        return int(b - a)

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of ``token``, ascending: from its run under the last plane back up by select."""
        if token >> self.bits:
            return np.zeros(0, np.int64)
        low, high = self._run(token, np.zeros(1, np.int64), np.full(1, self.n, np.int64))
        at = np.arange(low[0], high[0], dtype=np.int64)
        for level in range(self.bits - 1, -1, -1) if len(at) else []:
            one = token >> (self.bits - 1 - level) & 1
            at = self.planes[level].select(one, at - self.zeros[level] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order. From the last plane up, each plane's order is undone in one pass over its bits."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit, zeros = self.planes[level].all(), self.zeros[level]
            back = np.empty_like(ids)
            back[~bit] = ids[:zeros]
            back[bit] = ids[zeros:] | kind(1 << (self.bits - 1 - level))
            ids = back
        return ids.astype(np.uint32)


def write_shard(out, doc_ids: np.ndarray, null_docs: int, counts: np.ndarray, ids: np.ndarray, bits: int) -> None:
    """Writes one shard of documents with ``counts`` ids each to a binary file object; the first ``null_docs`` have no doc_id."""
    matrix = WaveletMatrix.build(ids, bits)
    sections = [("doc_ids", np.diff(doc_ids.astype("<i8"), prepend=0).tobytes()), ("counts", counts.astype("<i8").tobytes())]
    for level, plane in enumerate(matrix.planes):
        sections += [(f"sizes{level}", np.array([len(p) for p in plane.pages], "<u4").tobytes()), (f"ones{level}", plane.ones.astype("<i8").tobytes()), (f"pages{level}", b"".join(plane.pages))]
    at, table, parts = 0, {}, []
    for name, data in sections:
        part = data if name.startswith("pages") else _packed(data)
        table[name] = [at, len(part), len(data)]
        at += len(part)
        parts.append(part)
    head = _packed(json.dumps({"n": matrix.n, "bits": bits, "null_docs": null_docs, "zeros": matrix.zeros, "sections": table}).encode().ljust(1 << 14))
    out.write(MAGIC + struct.pack("<Q", len(head)) + head)
    for part in parts:
        out.write(part)


def read_shard(raw: bytes | memoryview) -> tuple[np.ndarray, int, np.ndarray, WaveletMatrix]:
    """Document ids, how many of them are null, starts (with the end) and the matrix of a shard's bytes."""
    raw = memoryview(raw)
    if bytes(raw[:8]) != MAGIC:
        raise ValueError("not a shard file")
    size = struct.unpack("<Q", raw[8:16])[0]
    head = json.loads(_unpacked(raw[16 : 16 + size], 1 << 14))

    def section(name: str) -> memoryview:
        at, length, _ = head["sections"][name]
        return raw[16 + size + at : 16 + size + at + length]

    def numbers(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(_unpacked(section(name), head["sections"][name][2]), kind)

    planes = []
    for level in range(head["bits"]):
        ends, data = np.cumsum(numbers(f"sizes{level}", "<u4"), dtype=np.int64).tolist(), section(f"pages{level}")
        planes.append(Plane(head["n"], [data[a:b] for a, b in zip([0, *ends], ends)], numbers(f"ones{level}", "<i8")))
    starts = np.concatenate([[0], np.cumsum(numbers("counts", "<i8"))])
    return np.cumsum(numbers("doc_ids", "<i8")), head["null_docs"], starts, WaveletMatrix(head["n"], head["bits"], planes, head["zeros"])


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, local or remote, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _written(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, spaced: bool, end_id: int, bits: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    store, base = open_folder(folder)
    pending: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
    held, rows = 0, []

    def flush() -> None:
        nonlocal held
        if not pending:
            return
        docs = np.concatenate([p[0] for p in pending])
        nulls = sum(p[1] for p in pending)
        counts = np.concatenate([p[2] for p in pending])
        ids = np.concatenate([p[3] for p in pending])
        path = f"{base}/{part:06d}-{len(rows):04d}-{uuid.uuid4().hex[:12]}.wvm"
        with store.open_output_stream(path) as out:
            write_shard(out, docs, nulls, counts, ids, bits)
        rows.append((path, part, len(rows), len(docs), len(ids), int(docs[0])))
        pending.clear()
        held = 0

    for batch in batches:
        doc_ids = batch.column("doc_id")
        known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = doc_ids.cast(pa.int64()).fill_null(0).to_numpy()
        for a, b, ids, bounds in bpe.encoded(batch.column("text"), tokenizer, spaced):
            counts = np.diff(bounds) + 1
            with_end = np.full(len(ids) + b - a, end_id, np.uint32)
            keep = np.ones(len(with_end), dtype=bool)
            keep[np.cumsum(counts) - 1] = False
            with_end[keep] = ids
            ends, at, row = np.cumsum(counts), 0, 0
            while row < b - a:
                stop = int(np.searchsorted(ends, at + shard_tokens - held, side="right"))
                if stop <= row and held:
                    flush()
                    continue
                stop = max(stop, row + 1)
                pending.append((numbers[a + row : a + stop], int((~known[a + row : a + stop]).sum()), counts[row:stop], with_end[at : ends[stop - 1]]))
                held += int(ends[stop - 1]) - at
                at, row = int(ends[stop - 1]), stop
    flush()
    columns = list(zip(*rows)) or [[]] * 6
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "part", "seq", "n_docs", "n_tokens", "first_doc"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, spaced: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes the texts, ``end_id`` after each, and writes shards in ascending doc_id order; returns the manifest, read back."""
    spark = docs.sparkSession
    small_batches(spark)
    bits = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()).bit_length()
    ordered = text_rows(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    store, base = open_folder(folder)
    store.create_dir(f"{base}/shards", recursive=True)
    shards = f"{folder}/shards"
    ordered.mapInArrow(lambda b: _written(b, shards, tokenizer, spaced, end_id, bits, shard_tokens), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row per shard with the number of ids in all shards before it: sums by writing task come first, so that the one
    task that puts them in order has a row for each of those."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts, "part").withColumn("start", F.col("first") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("first")


def shard_bytes(folder: str, path: str) -> bytes:
    store, _ = open_folder(folder)
    with store.open_input_file(path) as f:
        return f.read()


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            doc_ids, nulls, starts, matrix = read_shard(shard_bytes(folder, path))
            ids = matrix.decode().astype("<u4")
            crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            mask = np.arange(len(doc_ids)) < nulls
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=mask), pa.array(starts[:-1] + start), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document, from the shard files: its place in the whole sequence, its ids' number and checksum."""
    n = manifest.count()
    tasks = max(1, min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism), -(-n // SHARDS_A_TASK))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(lambda b: _read(b, folder), SCHEMA)


def token_counts(manifest: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """Occurrences of each of a few ids in every shard, by rank on its planes alone."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                matrix = read_shard(shard_bytes(folder, path))[3]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return manifest.select("path").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def new_folder(spark: SparkSession) -> str:
    return work_path(spark, "tokens")
