"""Token counts as delta-maintained rollups.

A store holds additive totals (documents, tokens) by source, language and
tokenizer version. It is changed by batches of signed changes: an insert adds a
document and its tokens, a delete takes them away, a revision replaces a count
by another. A batch is reduced to its net totals and written once, under its id;
a batch whose id is committed already changes nothing, so any batch may be sent
again. Totals are sums over the committed batches; :func:`compact` replaces the
batches by one of their sums and remembers their ids.

A batch's files are written to a folder of its own and become part of the store
by the commit marker that Spark's committer writes last; a writer that dies
before it leaves a folder that the next try replaces. One writer commits at a time.

Tokenizer versions are files of the tokenizers library (:class:`Bpe`), or byte
classes that make words, which SQL can count too.

Edge cases: null sources and languages are groups of their own; a null text is
empty and has no token, but is a document. Totals that come to nothing (no
documents, no tokens) are not returned. Repeated rows each count. An empty batch
is committed like any other. A change with a null count, or a revision without
the old one, is an error. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagpair.llm import bpe
from lagpair.llm import textkit as K
from lagpair.llm.common import discard, small_batches, stored, text_rows, work_path

KEYS = ("source", "lang", "tokenizer")
#: Changes: op is insert, delete or revise; old_tokens is used by revisions alone.
CHANGES = "source string, lang string, tokenizer string, op string, tokens long, old_tokens long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

@dataclass(frozen=True)
class Bpe:
    """A tokenizer of the tokenizers library, by its file; ``spaced`` as :class:`lagpair.llm.bpe.Encoder` has it."""

    path: str
    spaced: bool


#: Tokenizer versions that SQL can count too: what bytes a word is made of.
WORD_COUNTERS: dict[str, np.ndarray | Bpe] = {"words@1": K.SPACED, "alnum@1": K.ALNUM}


def library_tokenizers() -> dict[str, np.ndarray | Bpe]:
    """The versions that the registered rollup counts: two vocabulary files, and words beside them."""
    return {"byte_bpe_50k@1": Bpe(public_tokenizers.path("byte_bpe_50k.json"), True), "word_bpe_49k@1": Bpe(public_tokenizers.path("word_bpe_49k.json"), False), **WORD_COUNTERS}


def _counts(batches: Iterator[pa.RecordBatch], tokenizers: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column("source"), batch.column("lang")]
        for kind in tokenizers.values():
            n = np.zeros(batch.num_rows, np.int64)
            if isinstance(kind, Bpe):
                for a, b, _, bounds in bpe.encoded(batch.column("text"), kind.path, kind.spaced):
                    n[a:b] = np.diff(bounds)
            else:
                for a, b, raw, offsets in K.chunks(batch.column("text")):
                    n[a:b] = K.word_counts(raw, offsets, kind)
            columns.append(pa.array(n))
        yield pa.RecordBatch.from_arrays(columns, names=["source", "lang", *tokenizers])


def counted(docs: DataFrame, tokenizers: dict) -> DataFrame:
    """source, lang and each text's number of tokens in every tokenizer version; one pass over the texts."""
    small_batches(docs.sparkSession)
    schema = ", ".join(["source string", "lang string", *(f"`{t}` long" for t in tokenizers)])
    return text_rows(docs, "source", "lang", "text").mapInArrow(lambda b: _counts(b, tokenizers), schema)


def changes(rows: DataFrame, op: str, tokenizer: str, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Changes of one kind from rows with source and lang."""
    if op not in ("insert", "delete", "revise"):
        raise ValueError(f"unknown change: {op}")
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), tokens.cast("long").alias("tokens"), (F.lit(None) if old_tokens is None else old_tokens).cast("long").alias("old_tokens"))


def net(batch: DataFrame) -> DataFrame:
    """Signed totals of a batch of changes; partial sums come before the shuffle, so a source with a third of all rows is no burden."""
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.lit("unknown change")).cast("int"))
    tokens = F.when(F.col("op") == "revise", F.col("tokens") - F.col("old_tokens")).otherwise(sign * F.col("tokens"))
    known = F.coalesce(tokens, F.raise_error(F.lit("a change without its count")).cast("long"))
    return batch.groupBy(*KEYS).agg(F.sum(sign.cast("long")).alias("n_docs"), F.sum(known).cast("long").alias("n_tokens"))


class RollupStore:
    """Committed batches of net totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or work_path(spark, "rollup")
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[str]:
        root = self._jvm_path(self.path)
        if not self._fs.exists(root):
            return []
        return sorted(f"{self.path}/{s.getPath().getName()}" for s in self._fs.listStatus(root) if self._fs.exists(self._jvm_path(f"{self.path}/{s.getPath().getName()}/totals/_SUCCESS")))

    def _ids(self, folder: str) -> list[str]:
        return [r["batch_id"] for r in self.spark.read.schema("batch_id string").parquet(f"{folder}/ids").collect()]

    def _live(self) -> list[str]:
        """Committed folders but those that a compaction has taken over."""
        folders = self._folders()
        merged = [f for f in folders if f.rsplit("/", 1)[1].startswith("merged-")]
        taken = {i for f in merged[-1:] for i in self._ids(f)}
        return merged[-1:] + [f for f in folders if f not in merged and f.rsplit("/", 1)[1][len("batch-") :] not in taken]

    def committed(self) -> set[str]:
        out = {f.rsplit("/", 1)[1][len("batch-") :] for f in self._folders() if f.rsplit("/", 1)[1].startswith("batch-")}
        for f in self._folders():
            if f.rsplit("/", 1)[1].startswith("merged-"):
                out |= set(self._ids(f))
        return out

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Commits a batch of changes; False, and nothing is done, if its id is committed already."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ alone")
        if batch_id in self.committed():
            return False
        net(batch).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}/totals")
        return True

    def totals(self) -> DataFrame:
        """Sums over the committed batches; groups that came to nothing are left out."""
        parts = [f"{f}/totals" for f in self._live()]
        rows = self.spark.read.schema(TOTALS).parquet(*parts) if parts else self.spark.createDataFrame([], TOTALS)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """One batch of sums for all that are committed; their folders may be deleted afterwards."""
        ids = sorted(self.committed())
        number = 1 + sum(f.rsplit("/", 1)[1].startswith("merged-") for f in self._folders())
        folder = f"{self.path}/merged-{number:08d}"
        self.spark.createDataFrame([(i,) for i in ids], "batch_id string").write.mode("overwrite").parquet(f"{folder}/ids")
        self.totals().write.mode("overwrite").parquet(f"{folder}/totals")


def rollup(docs: DataFrame, store: RollupStore, tokenizers: dict | None = None) -> DataFrame:
    """Loads a table of documents as a pipeline would. All texts are inserted in every version; versions but the first are
    entered with the first one's count and then revised. The texts of one language are then deleted and inserted again, as
    when they are crawled anew, and that batch is sent twice. The totals are those of all documents."""
    tokenizers = library_tokenizers() if tokenizers is None else tokenizers
    rows = stored(counted(docs, tokenizers), "token-counts")
    first, *others = tokenizers
    count = {t: F.col(f"`{t}`") for t in tokenizers}

    def every(batches: list[DataFrame]) -> DataFrame:
        out = batches[0]
        for b in batches[1:]:
            out = out.unionByName(b)
        return out

    store.commit("load", every([changes(rows, "insert", t, count[first]) for t in tokenizers]))
    if others:
        store.commit("revise", every([changes(rows, "revise", t, count[t], count[first]) for t in others]))
    least = rows.agg(F.min("lang").alias("lang")).first()["lang"]
    again = rows.where(F.col("lang") == F.lit(least))
    crawled = every([changes(again, op, t, count[t]) for op in ("delete", "insert") for t in tokenizers])
    for _ in range(2):
        store.commit("crawled-again", crawled)
    store.compact()
    discard(rows)
    return store.totals()
