"""Language predictions against loops, ties and long texts."""

import zlib

import numpy as np
from test_pipeline_brute import grams

from lagpair.llm import language_id as L
from lagpair.llm.queries import QUERIES


def test_predictions_against_loops(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    letters, known = L.letter_vectors(L.DIMS).astype(np.int64), {}

    def vector(text):
        out = np.zeros(L.DIMS)
        for g, n in grams(text).items():
            if g not in known:
                known[g] = np.roll(letters[g[0]], 2) * np.roll(letters[g[1]], 1) * letters[g[2]]
            out += n * known[g]
        return out

    vectors = [vector(t) for _, t, _ in rows]
    sums = {}
    for (doc_id, text, lang), v in zip(rows, vectors):
        if zlib.crc32(str(doc_id).encode()) % 5 and lang is not None and text is not None:
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(sums)
    got = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (doc_id, text, _), v in zip(rows, vectors):
        if not grams(text):
            assert (got[doc_id]["lang_pred"], got[doc_id]["score"]) == ("und", 0.0)
            continue
        cosines = [float(v @ sums[n] / np.linalg.norm(v) / np.linalg.norm(sums[n])) for n in names]
        best = max(cosines)
        assert abs(got[doc_id]["score"] - min(max(best, 0), 1)) < 1e-4
        assert cosines[names.index(got[doc_id]["lang_pred"])] > best - 1e-4


def test_ties_repeated_rows_and_long_texts(spark, documents):
    text = "alpha beta gamma delta epsilon"
    train = [(k, text, "zz") for k in range(1, 9)] + [(k, text, "aa") for k in range(11, 19)] + [(k, "uno dos tres cuatro cinco", "es") for k in range(21, 29)]
    long = " ".join(["uno dos tres cuatro cinco"] * 60_000)
    rows = train + [(100, text, None), (100, text, None), (101, long, None), (None, "tres cuatro", None)]
    got = L.identify(documents(rows)).collect()
    assert len(got) == len(rows)
    of = lambda d: [r["lang_pred"] for r in got if r["doc_id"] == d]
    sizes = {lang: sum(1 for d, _, x in train if x == lang and zlib.crc32(str(d).encode()) % 5) for lang in ("aa", "zz")}
    assert min(sizes.values()) > 0 and of(100) == ["aa", "aa"]  # equal profiles: the one that sorts first
    assert of(101) == ["es"] and of(None) == ["es"]
