"""The pipeline's stages on the whole table, each against loops over what its predecessor kept."""

from collections import Counter

import numpy as np
import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_llm_operators import BASE, brute_components, brute_hits
from test_tokens import check_packing

from lagpair.llm import language_id as L
from lagpair.llm import secrets


def grams(text):
    slots, seq = L._tables()["letter slots"], [0]
    for c in text or "":
        s = int(slots[ord(c)])
        if s or seq[-1]:
            seq.append(s)
    seq.append(0)
    return Counter(zip(seq, seq[1:], seq[2:])) if any(seq) else Counter()


def identified(rows):
    """Rows (doc_id, text, lang) whose text may be in a language of the table."""
    letters, vectors = L.letter_vectors(L.DIMS).astype(np.int64), {}

    def vector(counts):
        out = np.zeros(L.DIMS)
        for g, n in counts.items():
            if g not in vectors:
                vectors[g] = np.roll(letters[g[0]], 2) * np.roll(letters[g[1]], 1) * letters[g[2]]
            out += n * vectors[g]
        return out

    counts = [grams(t) for _, t, _ in rows]
    bundled = [vector(c) for c in counts]
    sums, totals = {}, Counter()
    for (_, text, lang), c, v in zip(rows, counts, bundled):
        if lang is not None and text is not None and c:
            sums[lang] = sums.get(lang, 0) + v
            totals[lang] += sum(c.values())
    out = []
    for (doc_id, _, _), c, v in zip(rows, counts, bundled):
        for lang, total in sums.items():
            if not c:
                break
            norm = np.linalg.norm(total) / np.sqrt(L.DIMS)
            average = max(0, (norm**2 - totals[lang]) / (norm * max(totals[lang] - 1, 1)))
            size = sum(c.values()) / np.sqrt(sum(n * n for n in c.values()))
            cosine = v @ total / (np.linalg.norm(v) * np.linalg.norm(total))
            if cosine >= L.SHARE * size * average - L.DEVIATIONS / np.sqrt(L.DIMS):
                out.append(doc_id)
                break
    return out


def redacted(text):
    import re

    spans = list(secrets.confirmed_spans(text))
    for kind, pattern, least, group in BASE:
        spans += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    hidden = set()
    for a, b, _ in spans:
        hidden.update(range(a, b))
    out, at = "", 0
    while at < len(text):
        if at not in hidden:
            out, at = out + text[at], at + 1
            continue
        end = max(b for a, b, _ in spans if a <= at < b)
        while more := [b for a, b, _ in spans if a < end < b]:  # spans that overlap are one
            end = max(more)
        out, at = out + "[secret]", end
    return out


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, folder, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), tmp_path_factory.mktemp("stages"), {}
    out["documents"] = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect() if name == "packing" else [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    return out


def test_language_stage(stages):
    want = identified(stages["documents"])
    assert sorted(r[0] for r in stages["language_id"]) == sorted(want) and 0 < len(want)


def test_near_duplicate_stage(stages):
    found = brute_components([r[:2] for r in stages["language_id"]], 5)
    assert sorted(r[0] for r in stages["near_dedup"]) == sorted(d for d, (_, _, kept) in found.items() if kept)
    assert len(stages["near_dedup"]) < len(stages["language_id"])


def test_benchmark_stage(spark, sf_dir, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = brute_hits([r[:2] for r in stages["near_dedup"]], items)
    assert sorted(r[0] for r in stages["decontaminate"]) == sorted(d for d, r in found.items() if not r[4])


def test_secret_stage(stages):
    want = {d: redacted(t or "") for d, t, _ in stages["decontaminate"]}
    assert {d: t or "" for d, t, _ in stages["secrets"]} == want
    assert any("[secret]" in t for t in want.values())


def test_packing_stage_and_run(spark, sf_dir, stages):
    check_packing([r[:2] for r in stages["secrets"]], stages["packing"], 4096)
    placed = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert placed(P.run(spark, sf_dir).collect()) == placed(stages["packing"])


def test_repeated_rows_and_columns_that_clash(spark, documents, tmp_path):
    en = "the quick brown fox and the lazy dog were there with them and all of the others who came that day "
    rows = [(k, en * 2 + " ".join(f"w{k}x{j}" for j in range(40)), "en", "s") for k in range(20)]
    rows += [rows[3], rows[3], (3, rows[4][1], "en", "s"), (None, en * 2 + " ".join(f"w90x{j}" for j in range(40)), "en", "s"), (None, rows[5][1], "en", "s"), (30, None, None, None), (31, "", "en", "s")]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w7x1 w7x2 w7x3 w7x4")], "item_id long, text string").withColumn("window", F.lit(1)).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    # of equal texts the row with the least id stays: rows[4]'s text is kept under id 3, rows[5]'s under 5
    want = [(k, rows[k][1]) for k in range(20) if k not in (4, 7)] + [(3, rows[4][1]), (None, rows[23][1])]
    assert got == sorted(want, key=repr)
    assert all(r["mark_at"] == "x" and r["row_number"] == "x" for r in kept.collect())
    assert P.run(spark, str(tmp_path)).count() == len(want)
