"""MinHash near-duplicates by a multi-index Hamming join.

1. A pass over the texts gives each document's set of word shingles as a
   signature of ``SIGNATURE`` minhashes of 16 bits, its size and a 128-bit
   fingerprint. Documents with equal sets are one class from here on; the class
   is represented by its least doc_id.
2. The signature is split into ``CHUNKS`` chunks of ``WIDTH`` minhashes. Two
   signatures that differ in at most ``MOST_DIFFERENT`` minhashes agree, by
   pigeonhole, in some chunk but for ``ERRORS`` of its minhashes. All places of
   the error are enumerated: each chunk gives a key for each minhash left out.
   So every pair within that distance shares a key.
3. Classes that share a key are compared by their whole signatures, bucket by
   bucket. A bucket gives a spanning forest of the pairs within
   ``MOST_DIFFERENT``, never the pairs themselves. A pair of similarity 0.8 lies
   beyond with a probability of about 1e-7. The forests' components are the
   candidate groups.
4. Candidate groups get their texts; links are decided on full shingle sets,
   and a spanning forest of the links is emitted. Its components are the result.

Buckets over ``BLOCK`` rows and groups over ``GROUP`` documents or
``GROUP_SHINGLES`` shingles are dealt to blocks (:func:`linked`). Each block is
compared in itself and with one pivot of the whole, so members that are linked
with the pivot are sent once. Only the others are then compared with every block.

Documents' texts move only where they may be in a candidate group: ids that a
bitmap of fixed size (:func:`lagpair.llm.common.marks`) rules out stay where
they are. A class is dealt to ``SALTS`` parts, so copies of one text never
meet in one task.

Edge cases: a text of fewer words than a shingle, but not none, has its whole
sequence as its one shingle. A null or empty text, or one without a word, is
linked with nothing. Documents with a null doc_id get a null component and are
not kept. Rows that repeat a doc_id are one document whose rows' sets all count;
each row is returned. An empty table gives no rows. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagpair.llm import textkit as K
from lagpair.llm.common import discard, marked, marks, row_key, small_batches, stored, text_rows, without
from lagpair.llm.components import components

SIGNATURE = 64
CHUNKS, WIDTH, ERRORS = 16, 4, 1
#: The distance that the keys guarantee, which is also the one that a bucket's pairs must be within.
MOST_DIFFERENT = CHUNKS * (ERRORS + 1) - 1
#: Rows of a bucket, and documents of a candidate group, that one comparison holds.
BLOCK, GROUP = 2048, 1024
#: Parts of a class.
SALTS = 1024
#: Shingles of a candidate group that one comparison holds.
GROUP_SHINGLES = 4_000_000
#: Bits of the set matrix that a group's comparison holds at a time.
SLICE_BITS = 1 << 29

SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, signature binary"


def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minhashes (16 bits each) of non-empty sets that lie one after the other."""
    out = np.zeros((len(bounds) - 1, SIGNATURE), np.uint16)
    if len(out):
        for k, a in enumerate(_multipliers()):
            out[:, k] = (K.mix(np.minimum.reduceat(sets * a, bounds[:-1])) >> np.uint64(48)).astype(np.uint16)
    return out


def _sketched(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for a, b, raw, offsets in K.chunks(batch.column("text")):
            hashed, _, _, at = K.words(raw, offsets)
            sets, bounds = K.shingle_sets(hashed, at, shingle)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            prints = np.zeros((2, b - a), np.uint64)
            signed: list[bytes | None] = [None] * (b - a)
            if len(full):
                starts = bounds[full]
                for k, salt in enumerate((0x9E6C63D0876A9A47, 0x3C79AC492BA7B653)):
                    prints[k, full] = np.add.reduceat(K.mix(sets + np.uint64(salt)), starts)
                for r, s in zip(full.tolist(), signatures(sets, np.append(starts, len(sets)))):
                    signed[r] = s.tobytes()
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(signed, pa.binary())], names=["doc_id", "n_shingles", "fp1", "fp2", "signature"])


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    small_batches(docs.sparkSession)
    return text_rows(docs, "doc_id", "text").mapInArrow(lambda b: _sketched(b, shingle), SKETCH)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SIGNATURE)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        minhashes = _matrix(batch.column("signature")).astype(np.uint64)
        node = batch.column("node")
        for chunk in range(CHUNKS):
            for left_out in range(WIDTH):
                key = np.full(len(minhashes), 1 + chunk * WIDTH + left_out, np.uint64)
                for k in range(WIDTH):
                    if k != left_out:
                        key = K.mix(key * np.uint64(0x10001) + minhashes[:, chunk * WIDTH + k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node], names=["key", "node"])


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows with their bounds; a group that goes on in the next batch is carried over to it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        starts = [batch.column(k)[0].as_py() for k in keys]
        held.append(batch)
        if last == ends and starts == ends:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        changed = np.zeros(len(table) - 1, dtype=bool)
        for k in keys:
            values = table.column(k).to_numpy()
            changed |= values[1:] != values[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(table)]])
        if len(bounds) > 2:
            yield table.slice(0, int(bounds[-2])), bounds[:-1]
        held = table.slice(int(bounds[-2])).to_batches()
        last = ends
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, len(table)])


def roots(linked: np.ndarray) -> np.ndarray:
    """First row of each row's component, from a symmetric matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = np.array([i])
        while len(front):
            near = linked[front].any(axis=0) & (root < 0)
            front = np.flatnonzero(near)
            root[front] = i
    return root


#: What a comparison of units gives: links (a, b), and members of a block that are not linked with its pivot (a, and a null b).
FOUND = "unit long, a long, b long"


def _found(unit: list[int], a: list[int], b: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (unit, a, b)], names=["unit", "a", "b"])


def _spanned(linked: np.ndarray, node: np.ndarray, pivot: int | None) -> tuple[list[tuple[int, int]], list[int]]:
    """A spanning forest of a unit's links, and the nodes that have no path to the pivot, if there is one."""
    root = roots(linked)
    edges = [(int(node[r]), int(node[k])) for k, r in enumerate(root.tolist()) if r != k]
    if pivot is None:
        return edges, []
    return edges, node[root != root[np.flatnonzero(node == pivot)[0]]].tolist()


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in runs(batches, "unit", "p", "q"):
        node, size = table.column("node").to_numpy(), table.column("n_shingles").to_numpy()
        unit, pivot = table.column("unit").to_numpy(), table.column("pivot").take(pa.array(bounds[:-1])).to_pylist()
        minhashes = _matrix(table.column("signature").combine_chunks())
        widths = np.diff(bounds)
        whole = np.array([x is None for x in pivot], dtype=bool)
        edges: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        for width in (2, 3, 4):  # all such buckets at once: no more than six pairs each
            first = bounds[:-1][(widths == width) & whole]
            i, j = np.triu_indices(width, 1)
            a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            near = (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])) & ((minhashes[a] != minhashes[b]).sum(axis=1) <= MOST_DIFFERENT)
            edges.append(np.stack([node[a[near]], node[b[near]]], axis=1))
        left: list[tuple[int, int]] = []
        for k in np.flatnonzero((widths > 4) | ~whole).tolist():
            s, e = int(bounds[k]), int(bounds[k + 1])
            width, block, sizes = e - s, minhashes[s:e], size[s:e]
            near = np.zeros((width, width), dtype=bool)
            step = max(1, (1 << 22) // (width * SIGNATURE))
            for r in range(0, width, step):
                near[r : r + step] = (block[r : r + step, None, :] != block[None, :, :]).sum(axis=2) <= MOST_DIFFERENT
            near &= 5 * np.minimum(sizes[:, None], sizes) >= 4 * np.maximum(sizes[:, None], sizes)
            forest, alone = _spanned(near, node[s:e], pivot[k])
            edges.append(np.array(forest, np.int64).reshape(-1, 2))
            left += [(int(unit[s]), n) for n in alone]
        found = np.unique(np.concatenate(edges), axis=0)
        found = found[found[:, 0] != found[:, 1]]
        yield _found([0] * len(found) + [u for u, _ in left], found[:, 0].tolist() + [n for _, n in left], found[:, 1].tolist() + [None] * len(left))


def blocks_of(size: Column, most: int) -> Column:
    """One block up to ``most``, beyond it as many as halves of that are needed: two blocks then hold about ``most``."""
    return F.when(size <= most, 1).otherwise(F.ceil(size / F.lit(most / 2))).cast("int")


def linked(members: DataFrame, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], half: int, name: str) -> DataFrame:
    """Links (a, b) that connect whatever pairs of a unit's members ``compare`` links, stored.

    ``members`` has unit, node, pivot (a node of the unit), blocks and what ``compare`` reads. A unit of one block is compared
    at once. Members of a unit of several are dealt to its blocks and compared within their block and with the pivot. Members
    that are not linked with the pivot there, dealt ``half`` at a time, are then compared with every block.
    """
    payload = [c for c in members.columns if c not in ("unit", "node", "pivot", "blocks")]
    columns = ["unit", "p", "q", "pivot", "node", *payload]
    none, zero = F.lit(None).cast("long"), F.lit(0)

    def place(p: Column, q: Column, pivot: Column = none) -> Column:
        return F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), pivot.alias("hub"))

    def every(n: Column, of: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(zero, n - 1), of)

    def compared(rows: DataFrame, places: Column) -> DataFrame:
        dealt = rows.select("unit", F.explode(places).alias("at"), "node", *payload).select("unit", "at.p", "at.q", F.col("at.hub").alias("pivot"), "node", *payload)
        units = dealt.select(*columns).repartition("unit", "p", "q").sortWithinPartitions("unit", "p", "q", "node")
        return stored(units.mapInArrow(compare, FOUND), name)

    blocks, own, pivot = F.col("blocks"), F.pmod(F.xxhash64("node"), F.col("blocks")), F.col("pivot")
    alone = F.when(F.col("node") == pivot, every(blocks, lambda p: place(p, zero, pivot))).otherwise(F.array(place(own, zero, pivot)))
    first = compared(members, F.when(blocks == 1, F.array(place(zero, zero))).otherwise(alone))
    left = first.where("b is null").select("unit", F.col("a").alias("node"), F.lit(True).alias("left")).distinct()
    if left.isEmpty():
        return first
    parts = left.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / F.lit(half)).cast("int").alias("parts"))
    rest = members.where("blocks > 1").join(parts, "unit").join(left, ["unit", "node"], "left")
    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    met = every(F.col("parts"), lambda p: place(p, own))  # the parts of those that are left, where this one's block meets them
    both = F.concat(every(blocks, lambda q: place(mine, q)), F.filter(met, lambda x: x["p"] != mine))
    second = compared(rest, F.when(F.col("left"), both).otherwise(met))
    return first.unionByName(second)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that may have a link; ``classes`` has node, n_shingles, signature."""
    small_batches(classes.sparkSession)
    keyed = classes.select("node", "signature").mapInArrow(_keys, "key long, node long")
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("node").alias("pivot")).where("copies > 1"), "shared-keys")
    members = keyed.join(shared, "key").join(classes.select("node", "n_shingles", "signature"), "node")
    units = members.select(F.col("key").alias("unit"), "node", "pivot", blocks_of(F.col("copies"), BLOCK).alias("blocks"), "n_shingles", "signature")
    found = linked(units, _bucket_links, BLOCK // 2, "bucket-links")
    out = components(found.where("b is not null").select("a", "b"))
    discard(shared)
    return out


def _intersections(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by bit rows over the shingles that more than one set has."""
    n = len(bounds) - 1
    out = np.zeros((n, n), dtype=np.int64)
    values, place, count = np.unique(sets, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    common = count[place] > 1
    row, column = np.repeat(np.arange(n), np.diff(bounds))[common], rank[place][common]
    width = int((count > 1).sum())
    step = max(64, SLICE_BITS // max(n, 1) // 64 * 64)
    for low in range(0, width, step):
        mine = (column >= low) & (column < low + step)
        bits = np.zeros((n, -(-min(step, width - low) // 64) * 8), np.uint8)
        r, c = row[mine], column[mine] - low
        np.bitwise_or.at(bits, (r, c >> 3), (1 << (c & 7)).astype(np.uint8))
        bits = bits.view(np.uint64)
        for i in range(n - 1):
            out[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
    return out + out.T


def links(sets: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union, exactly."""
    sizes = np.diff(bounds)
    inter = _intersections(sets, bounds)
    return (100 * inter >= percent * (sizes[:, None] + sizes - inter)) & (sizes[:, None] > 0) & (sizes > 0)


def _text_links(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    for table, bounds in runs(batches, "unit", "p", "q"):
        node, text = table.column("node").to_numpy(), table.column("text").combine_chunks()
        unit, pivot = table.column("unit").to_numpy(), table.column("pivot").take(pa.array(bounds[:-1])).to_pylist()
        parts, at = [], [0]
        for _, _, raw, offsets in K.chunks(text):
            hashed, _, _, words_at = K.words(raw, offsets)
            sets, ends = K.shingle_sets(hashed, words_at, shingle)
            parts.append(sets)
            at += (ends[1:] + at[-1]).tolist()
        everything, at = np.concatenate(parts), np.array(at)
        edges: list[tuple[int, int]] = []
        left: list[tuple[int, int]] = []
        for s, e, hub in zip(bounds[:-1].tolist(), bounds[1:].tolist(), pivot):
            if e - s < 2:
                continue
            forest, alone = _spanned(links(everything[at[s] : at[e]], at[s : e + 1] - at[s], percent), node[s:e], hub)
            edges += forest
            left += [(int(unit[s]), n) for n in alone]
        yield _found([0] * len(edges) + [u for u, _ in left], [a for a, _ in edges] + [n for _, n in left], [b for _, b in edges] + [None] * len(left))


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the classes of a candidate group as all links of their full sets do."""
    every = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "n_shingles"), "node")
    sizes = stored(every.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight")), "group-sizes")
    blocks = F.greatest(blocks_of(F.col("members"), GROUP), blocks_of(F.col("weight"), GROUP_SHINGLES))
    placed = stored(every.select("node", "root").join(sizes, "root").select(F.col("root").alias("unit"), "node", F.col("root").alias("pivot"), blocks.alias("blocks")), "placed")
    texts, _ = marked(text_rows(docs, "doc_id", "text").withColumnRenamed("doc_id", "node"), "node", marks(placed, "node"))
    held = stored(texts.join(placed, "node"), "group-texts")
    found = linked(held, lambda b: _text_links(b, shingle, percent), GROUP // 2, "text-links")
    discard(sizes, placed, held)
    return found.where("b is not null").select("a", "b")


def _covered(percent: int) -> None:
    if percent < 80:
        raise ValueError("keys, distances and the size filter find links of 80 percent and more alone")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``; ``percent`` is the least similarity of a link, 80 at least."""
    _covered(percent)
    small_batches(docs.sparkSession)
    sketch = stored(sketches(docs, shingle).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "sketches")
    prints = ["fp1", "fp2"]
    linkable = sketch.where("n_shingles > 0 and doc_id is not null")
    parts = stored(linkable.groupBy(*prints, "salt").agg(F.min("doc_id").alias("least")), "class-parts")
    least = stored(parts.groupBy(*prints).agg(F.min("least").alias("node")), "class-ids")
    owners = linkable.join(least.withColumnRenamed("node", "doc_id"), [*prints, "doc_id"]).dropDuplicates([*prints, "doc_id"])
    classes = stored(owners.select(F.col("doc_id").alias("node"), "n_shingles", "signature"), "classes")
    edges = confirmed_links(docs, classes, candidate_groups(classes), shingle, percent)
    repeated = linkable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    same_id = linkable.join(repeated, "doc_id").select("doc_id", *prints).distinct().join(least, prints).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(edges.unionByName(same_id))
    rooted = least.join(found, "node", "left").select(*prints, F.coalesce("root", "node").alias("root"))
    placed = parts.join(rooted, prints).select(*prints, "salt", "root")
    of_class = linkable.join(placed, [*prints, "salt"]).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    alone = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = stored(of_class.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "near-duplicates")
    discard(sketch, parts, least, classes)
    return out


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; all columns stay.

    The row with the least doc_id stays. Where ids are null or repeat, rows are told apart by a number of their own, and of
    rows of equal ids the one that was numbered first stays; a row without an id stays only if no row of its group has one.
    """
    _covered(percent)
    rows, key = row_key(docs, "documents")
    if key == "doc_id":
        return without(docs, key, near_duplicates(docs, shingle, percent).where("not kept").select(key))
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), shingle, percent).select(F.col("doc_id").alias("number"), "component_id")
    placed = rows.select(F.col(key).alias("number"), "doc_id").join(found, "number")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "number")
    first = placed.groupBy("component_id").agg(F.min(order).alias("first")).select("first.number")
    gone = placed.select("number").join(first, "number", "left_anti").withColumnRenamed("number", key)
    return without(rows, key, gone).select(*(F.col(f"`{c}`") for c in docs.columns))
