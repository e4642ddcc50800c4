"""Rollups against counts by the library and by patterns, text by text."""

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lagpair.llm import token_counts
from lagpair.llm.queries import QUERIES

WORDS = {"words@1": re.compile("[^\x20\x09-\x0d]+"), "alnum@1": re.compile("[0-9A-Za-z\x80-\U0010ffff]+")}
FILES = {"byte_bpe_50k@1": "byte_bpe_50k.json", "word_bpe_49k@1": "word_bpe_49k.json"}


def brute(rows):
    """Totals of rows (source, lang, text)."""
    out = Counter()
    for name, file in FILES.items():
        encoded = Tokenizer.from_file(public_tokenizers.path(file)).encode_batch([t or "" for _, _, t in rows], add_special_tokens=False)
        for (source, lang, _), e in zip(rows, encoded):
            out[source, lang, name, "docs"] += 1
            out[source, lang, name, "tokens"] += len(e.ids)
    for name, pattern in WORDS.items():
        for source, lang, text in rows:
            out[source, lang, name, "docs"] += 1
            out[source, lang, name, "tokens"] += len(pattern.findall(text or ""))
    return out


def read(df):
    out = Counter()
    for r in df.collect():
        out[r["source"], r["lang"], r["tokenizer"], "docs"] += r["n_docs"]
        out[r["source"], r["lang"], r["tokenizer"], "tokens"] += r["n_tokens"]
    return out


def test_the_table(spark, sf_dir):
    rows = [(r["source"], r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert read(QUERIES["op2_token_counts"](spark, sf_dir)) == brute(rows)


def test_edge_rows(spark, documents):
    rows = [(1, "one <|endoftext|> two", "en", "s"), (1, "one <|endoftext|> two", "en", "s"), (2, None, "en", "s"), (3, "", "fr", "only empty"), (4, " \n ", None, None), (5, "x " * 50_000, "de", "s"), (None, "Null id", None, "s")]
    docs = documents(rows)
    full = [(r["source"], r["lang"], r["text"]) for r in docs.collect()]
    assert read(token_counts.rollup(docs, token_counts.RollupStore(spark))) == brute(full)
    assert token_counts.rollup(documents([]), token_counts.RollupStore(spark)).count() == 0


def test_changes_without_a_count_are_errors(spark):
    store = token_counts.RollupStore(spark)
    for bad in (("s", "en", "t", "revise", 5, None), ("s", "en", "t", "insert", None, None)):
        with pytest.raises(Exception):
            store.commit("bad", spark.createDataFrame([bad], token_counts.CHANGES))
    assert store.totals().count() == 0 and not store.committed()
    assert store.commit("none", spark.createDataFrame([], token_counts.CHANGES)) and not store.commit("none", spark.createDataFrame([], token_counts.CHANGES))
    twice = spark.createDataFrame([("s", "en", "t", "insert", 5, None)] * 2, token_counts.CHANGES)
    assert store.commit("twice", twice)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "t", 2, 10)]
