"""The toxicity classifier's grams, counts and ratios against loops, and what it finds among labelled rows it has not seen."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagpair.llm import textkit as K
from lagpair.llm import toxicity as T
from lagpair.llm.queries import QUERIES


def lowered(text):
    return "".join(" " if c.isspace() else c.lower() if c.isupper() and len(c.lower()) == 1 else c for c in text)


def brute_grams(text):
    padded = f" {lowered(text)} "
    return {padded[i : i + n] for n in (4, 5, 6) for i in range(len(padded) - n + 1)}


def place(gram, bits):
    """The place that the operator gives one gram."""
    acc = ord(gram[0])
    for c in gram[1:]:
        acc = (acc * 0x100000001B3 + ord(c)) % (1 << 64)
    return int(K.mix(np.array([(acc + len(gram)) % (1 << 64)], np.uint64))[0]) >> (64 - bits)


def test_grams_against_loops():
    rng = random.Random(4)
    texts = ["", "a", "Ab", "abc\ndef", "ÀÉ ß İ", "日本語テキスト", "x" * 300] + ["".join(rng.choice("abC é\t😀") for _ in range(rng.randrange(60))) for _ in range(80)]
    raw, offsets = K.utf8(pa.array(texts, pa.large_string()))
    row, got = T.grams(raw, offsets, 30)
    for k, text in enumerate(texts):
        assert sorted(got[row == k].tolist()) == sorted({place(g, 30) for g in brute_grams(text)})


def test_counts_and_ratios_against_loops():
    rng = random.Random(9)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randrange(30))), rng.randrange(2), rng.randrange(T.INNER)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[0] for r in rows])], names=["toxic", "part", "text"])
    want, total = defaultdict(Counter), Counter()
    for text, toxic, part in rows:
        name = f"{'nt'[toxic]}{part}"
        total[name] += 1
        for p in {place(g, T.BITS) for g in brute_grams(text)}:
            want[p][name] += 1
    got = defaultdict(Counter)
    for out in T._class_counts(iter([batch.slice(0, 77), batch.slice(77)]), T.BITS):
        for r in out.to_pylist():
            got[r["place"]][T.COUNTS[r["kind"]]] += r["n"]
    assert got.pop(-1) == total
    assert got == want
    ratio, z = T.ratios(np.array([9.0]), np.array([4.0]), 100, 50)
    r = math.log(5 / 52) - math.log(10 / 102)
    assert math.isclose(ratio[0], r) and math.isclose(z[0], abs(r) / math.sqrt(1 / 5 - 1 / 52 + 1 / 10 - 1 / 102))


def test_features_are_those_that_the_ratios_choose(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, *rng.integers(0, 12, 2 * T.INNER).tolist()) for k in range(400)]
    total = np.full(2 * T.INNER, 40)
    df = spark.createDataFrame(rows, "place long, " + ", ".join(f"{c} long" for c in T.COUNTS))
    counts = np.array([r[1:] for r in rows], float)
    want = set()
    for out in (None, *range(T.INNER)):
        mine = [k for k in range(T.INNER) if k != out]
        clean, toxic = (sum(counts[:, 2 * k + i] for k in mine) for i in (0, 1))
        want |= set(np.flatnonzero(T.used(clean, toxic, 40 * len(mine), 40 * len(mine))).tolist())
    got = {r["place"] for r in T._surest(df, total).collect()}
    assert want and want <= got and len(got) <= len(want) + 3
    monkeypatch.setattr(T, "MAX_FEATURES", 5)
    assert T._surest(df, total).count() == 5


def test_the_best_cut():
    z, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0, 0, 0, 1, 1, 1])
    assert T.best_cut(z, y) is None  # three clean rows show nothing
    assert T.best_cut(np.append(np.linspace(0, 2, 200), [3.0, 4.0]), np.append(np.zeros(200), [1, 1])) == 2.5
    clean = np.linspace(0, 1, 1000)
    cut = T.best_cut(np.append(clean, [0.5, 2.0, 3.0]), np.append(np.zeros(1000), [1, 1, 1]))
    assert 1.0 < cut <= 2.0


def test_edge_rows(spark, documents):
    rng = random.Random(6)
    words = ["lorem", "ipsum", "dolor", "sit", "amet"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(12)) + (" vile troll" if k % 4 == 0 else "")) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(240)], "doc_id long, toxic int")
    long = " ".join(rng.choice(words) for _ in range(60_000)) + " vile troll"
    more = [(900, long), (901, long), (901, "vile troll"), (901, "vile troll"), (902, None), (903, "")]
    got = T.classify(documents(rows + more), labels).collect()
    assert len(got) == len(rows) + len(more)
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r["score"])
    assert of[900][0] in of[901] and len(of[901]) == 3 and len(set(of[901])) == 2 and of[902] == of[903] and of[902][0] < 0.7 <= min(of[901])
    assert T.classify(documents([]), labels).count() == 0
    one = T.classify(documents(rows), labels.where("toxic = 1")).agg(F.max("score")).first()[0]
    assert one == 0.0


@pytest.mark.parametrize("sf,least", [("/root/testdata/sf0.1", 0.9)])
def test_held_out_rows(spark, sf, least):
    out = QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out)
    toxic, clean = [r["predicted"] for r in out if r["toxic"] == 1], [r["predicted"] for r in out if r["toxic"] == 0]
    assert sum(toxic) >= least * len(toxic) and sum(clean) <= 0.02 * len(clean)
