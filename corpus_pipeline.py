"""A corpus pipeline of five stages: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes the documents that its predecessor kept, as a Parquet table.
The first three drop rows, the fourth rewrites texts and the last returns packed
pieces. Nulls, empty texts and empty tables pass as the operators define it:
texts without a letter are dropped as having no language, unless no row is
labelled; rows without a doc_id stay until they are packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagpair.llm import decontaminate, language_id, near_dedup, packing, secrets
from lagpair.llm.common import documents, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from all labelled rows and drops texts that are in none; texts too short to be judged stay."""
    return language_id.keep_identified(docs, language_id.learnt(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages learn, hash and tokenise: SQL cannot express them. Tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the table of documents; every stage but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
