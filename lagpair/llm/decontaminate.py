"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item (all words of a
shorter item). As a window must be contained whole, the prefix that the filter
needs is one token: its rarest shingle of ``PREFIX_WORDS`` words. Shingles of the
benchmark are ordered by how often they occur in the documents, which a pass
over all of them counts; a window with a shingle that no document has cannot
occur.

A second pass finds the places of documents where a prefix token may stand and
gives each with the words around it. These places are joined with the tokens.
The token's place in the window fixes where the window would start; the bounds
of the document drop what cannot fit (position and length), and the window is
compared with the words, byte by byte.

Both passes ask a bitmap of fixed size (``MARK_WORDS`` words of 64 bits, 4 MB)
whether a shingle is one of the benchmark's. With a very large benchmark it rules
out less and more places go to the join; it never decides anything. Neither the
benchmark nor its tokens are collected, and nothing depends on their number.
Rows are judged one by one: by their doc_id, or by a number that is written with
them where ids are null or repeat.

Edge cases: a null or empty text, or one without a word, has no words and is
never hit. An item that repeats (equal text) is an item of its own; rows that
repeat an item_id count once. A null item_id is ignored. An empty benchmark hits
nothing. Columns other than those named are ignored. Repeated documents each
give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagpair.llm import textkit as K
from lagpair.llm.common import discard, row_key, small_batches, stored, text_rows, without

WINDOW_WORDS = 10
PREFIX_WORDS = 3
#: Words of the bitmap of shingles, as a power of two.
MARK_BITS = 19

CANDIDATES = "key long, n_words long, length int, token long, word long, before int, around string"


def item_windows(texts: list[str | None], size: int = WINDOW_WORDS) -> list[tuple[int, tuple[bytes, ...]]]:
    """(position in ``texts``, words) of every window of every item."""
    raw, offsets = K.utf8(pa.array(texts, pa.large_string()))
    _, start, end, at = K.words(raw, offsets, K.ALNUM)
    low = K.LOWER[raw].tobytes()
    out = []
    for i in range(len(texts)):
        words = [low[s:e] for s, e in zip(start[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist())]
        if words:
            out += [(i, tuple(words[k : k + size])) for k in range(max(1, len(words) - size + 1))]
    return out


def _windows_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        got = item_windows(batch.column("text").to_pylist(), size)
        columns = [pa.array([str(ids[i]) for i, _ in got], pa.string()), pa.array([b" ".join(w).decode() for _, w in got], pa.string()), pa.array([len(w) for _, w in got], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "window", "n"])


def windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows (words joined by a blank), their number of words and the ids of the items that hold them."""
    small_batches(benchmark.sparkSession)
    each = text_rows(benchmark.where("item_id is not null"), "item_id", "text").mapInArrow(lambda b: _windows_of(b, size), "item_id string, window string, n int")
    return each.groupBy("window", "n").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _shingles(batches: Iterator[pa.RecordBatch], prefix: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in K.chunks(batch.column("window")):
            hashed, _, _, at = K.words(raw, offsets, K.ALNUM)
            counts = np.diff(at)
            for n in np.unique(counts).tolist():
                length, pick = min(prefix, n), np.flatnonzero(counts == n)
                token, _ = K.windows(hashed[K.ragged(at[pick], np.full(len(pick), n))], np.arange(len(pick) + 1) * n, length)
                each = n - length + 1
                row = pa.array(a + np.repeat(pick, each))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("window").take(row), pa.array(np.full(len(token), length), pa.int32()), pa.array(np.tile(np.arange(each), len(pick)), pa.int32()), pa.array(token.view(np.int64))],
                    names=["window", "length", "place", "token"],
                )


def bitmap(tokens: DataFrame) -> np.ndarray:
    """The bitmap of a column of hashes: what comes to the driver is its words, however many hashes there are."""
    word = F.shiftrightunsigned("token", 64 - MARK_BITS).cast("int").alias("word")
    rows = tokens.select(word, F.expr("shiftleft(1L, cast(shiftright(token, 32) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(1 << MARK_BITS, np.int64)
    out[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return out.view(np.uint64)


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap."""
    words = bits[(hashes >> np.uint64(64 - MARK_BITS)).astype(np.int64)]
    return ((words >> ((hashes >> np.uint64(32)) & np.uint64(63))) & np.uint64(1)).astype(bool)


def _counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offsets in K.chunks(batch.column("text")):
            hashed, _, _, at = K.words(raw, offsets, K.ALNUM)
            for length in lengths:
                found = K.windows(hashed, at, length)[0]
                token, n = np.unique(found[_marked(bits, found)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), length), pa.int32()), pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["length", "token", "n"])


def prefix_tokens(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, prefix: int = PREFIX_WORDS) -> DataFrame:
    """(length, token, place, n, window, items): the rarest shingle, among all documents, of every window that may occur; stored."""
    spark = docs.sparkSession
    small_batches(spark)
    found = stored(windows(benchmark, size), "windows")
    shingles = stored(found.select("window").mapInArrow(lambda b: _shingles(b, prefix), "window string, length int, place int, token long"), "shingles")
    lengths = sorted(r["length"] for r in shingles.select("length").distinct().collect())
    shipped = spark.sparkContext.broadcast(bitmap(shingles))
    seen = text_rows(docs, "text").mapInArrow(lambda b: _counted(b, shipped.value, lengths), "length int, token long, n long")
    counts = seen.groupBy("length", "token").agg(F.sum("n").alias("count"))
    ordered = shingles.join(counts, ["length", "token"], "left").select("window", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "place", "length", "token").alias("s"))
    rarest = ordered.groupBy("window").agg(F.min("s").alias("s")).where("s.count > 0")
    out = stored(rarest.join(found, "window").select("s.length", "s.token", "s.place", "n", "window", "items"), "prefix-tokens")
    discard(found, shingles)
    return out


def _candidates(batches: Iterator[pa.RecordBatch], key: str, bits: np.ndarray, lengths: list[int], size: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        keys = batch.column(key).cast(pa.int64())
        for a, b, raw, offsets in K.chunks(batch.column("text")):
            hashed, start, end, at = K.words(raw, offsets, K.ALNUM)
            low = K.LOWER[raw].tobytes()
            none = pa.nulls(b - a)
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(np.diff(at)), *(none.cast(k) for k in kinds[2:])], names=names)
            for length in lengths:
                found, first = K.windows(hashed, at, length)
                hit = np.flatnonzero(_marked(bits, found))
                if not len(hit):
                    continue
                word = first[hit]
                row = np.searchsorted(at, word, side="right") - 1
                low_word, high_word = np.maximum(at[row], word - (size - length)), np.minimum(at[row + 1], word + size)
                around = [b" ".join(low[s:e] for s, e in zip(start[x:y].tolist(), end[x:y].tolist())).decode() for x, y in zip(low_word.tolist(), high_word.tolist())]
                columns = [keys.take(pa.array(a + row)), np.diff(at)[row], np.full(len(hit), length), found[hit].view(np.int64), word - at[row], word - low_word, around]
                yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:]))], names=names)


def candidates(rows: DataFrame, key: str, prefixes: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """A row for every document (key, n_words), and one for each of its places where a prefix token may stand."""
    spark = rows.sparkSession
    small_batches(spark)
    lengths = sorted(r["length"] for r in prefixes.select("length").distinct().collect())
    shipped = spark.sparkContext.broadcast(bitmap(prefixes))
    return text_rows(rows, key, "text").mapInArrow(lambda b: _candidates(b, key, shipped.value, lengths, size), CANDIDATES)


def occurrences(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, first, n, items) of each window that occurs, by its first word's number: candidates joined with prefix tokens."""
    first = F.col("word") - F.col("place")
    near = places.where("token is not null").join(prefixes, ["length", "token"]).where((first >= 0) & (first + F.col("n") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ") == F.col("window")
    return near.where((F.col("before") >= F.col("place")) & same).select("key", first.alias("first"), F.col("n").cast("long").alias("n"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, prefix: int = PREFIX_WORDS) -> DataFrame:
    """A row per document: its words, hit words, the items whose windows occur in it, and the runs of hit words."""
    rows, key = row_key(docs, "documents")
    prefixes = prefix_tokens(rows, benchmark, size, prefix)
    places = stored(candidates(rows, key, prefixes, size), "places")
    hits = stored(occurrences(places, prefixes), "hits")
    end = F.col("first") + F.col("n")
    before = Window.partitionBy("key").orderBy("first", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key", "first", end.alias("end")).distinct().withColumn("n", F.col("end") - F.col("first"))
    opened = spans.withColumn("opens", F.coalesce(F.col("first") > F.max("end").over(before), F.lit(True)).cast("int"))
    runs = opened.withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "run").agg(F.min("first").alias("s"), F.max("end").alias("e"))
    of_row = runs.groupBy("key").agg(F.sum(F.col("e") - F.col("s")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))
    items = hits.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    every = places.where("token is null").select("key", "n_words").join(of_row.join(items, "key"), "key", "left").withColumn("items", F.coalesce("items", none))
    named = every.withColumnRenamed("key", "doc_id") if key == "doc_id" else every.join(rows.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id")), "key")
    out = stored(
        named.select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
            (F.size("items") > 0).alias("contaminated"),
            "items",
            F.coalesce(F.transform("runs", lambda r: r["s"]), F.array().cast("array<long>")).alias("hit_starts"),
            F.coalesce(F.transform("runs", lambda r: r["e"]), F.array().cast("array<long>")).alias("hit_ends"),
        ),
        "contamination",
    )
    discard(prefixes, places, hits)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, prefix: int = PREFIX_WORDS) -> DataFrame:
    """Rows of ``docs`` in which no window occurs; all columns stay."""
    rows, key = row_key(docs, "documents")
    prefixes = prefix_tokens(rows, benchmark, size, prefix)
    bad = occurrences(candidates(rows, key, prefixes, size), prefixes).select(F.col("key").alias(key)).distinct()
    return without(rows, key, bad).select(*(F.col(f"`{c}`") for c in docs.columns))
