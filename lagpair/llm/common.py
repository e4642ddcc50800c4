"""Row keys, bitmaps of ids and Arrow settings; tables of intermediate results are the library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagpair.sources.shared import discard, remove, shared_dir, stored, work_path

__all__ = ["discard", "remove", "shared_dir", "stored", "work_path"]

#: Bytes and rows of the Arrow batches that Python operators get.
ARROW_BYTES = "4m"
ARROW_ROWS = "4096"


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or the like of it that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` stored with a number of its own for every row, and that column's name; every later read has the same numbers."""
    row = fresh("row_number", df)
    return stored(df.withColumn(row, F.monotonically_increasing_id()), name), row


def row_key(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows with a column that tells them apart: doc_id where no id is null or repeats, else a number written with the rows."""
    ids = docs.select("doc_id")
    if ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, "doc_id"
    return numbered(docs, name)


#: Words of a :func:`marks` table, at most: 64 bits each, some 24 MB where all of them are in use.
MARK_WORDS = 1 << 19


def _mark(column: str) -> tuple[Column, Column]:
    """Word and bit of an id in a :func:`marks` table."""
    h = F.xxhash64(F.col(column).cast("long"))
    return F.pmod(h, F.lit(MARK_WORDS)).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(cast(`{column}` as bigint)), 40), 64) as int))")


def marks(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of the hashes of ids, to be broadcast: (word, bits), of at most ``MARK_WORDS`` rows however many ids there are."""
    word, bit = _mark(column)
    return ids.where(F.col(f"`{column}`").isNotNull()).select(word.alias("mark_word"), bit.alias("bit")).groupBy("mark_word").agg(F.bit_or("bit").alias("mark_bits"))


def marked(rows: DataFrame, column: str, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be one of those of ``table``, rows whose id is surely none), without a shuffle.

    With many more ids than bits the first part is nearly all rows: the filter saves work and never decides anything.
    """
    word, bit = _mark(column)
    at, of, bits = (fresh(n, rows) for n in ("mark_at", "mark_of", "mark_all"))
    words = table.select(F.col("mark_word").alias(of), F.col("mark_bits").alias(bits))
    wide = rows.withColumn(at, bit).join(F.broadcast(words), word == F.col(of), "left")
    hit = F.coalesce((F.col(bits).bitwiseAND(F.col(at)) != 0) & F.col(f"`{column}`").isNotNull(), F.lit(False))
    names = [F.col(f"`{c}`") for c in rows.columns]
    return wide.where(hit).select(*names), wide.where(~hit).select(*names)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose key is not in ``gone``; only rows that may be in it are shuffled."""
    gone = stored(gone, "gone")
    maybe, clear = marked(rows, key, marks(gone, key))
    return clear.unionByName(maybe.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns)))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes, for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs`` alone, whatever else it has."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))
