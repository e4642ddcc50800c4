import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lagpair.llm import bpe, packing, token_store
from lagpair.llm import textkit as K

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def direct(path, text):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(text, add_special_tokens=False)]


def thue_morse(k, letters="ab"):
    word, other = letters
    for _ in range(k):
        word, other = word + other, other + word
    return word, other


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_encoder_equals_the_library(path, spaced):
    rng = random.Random(3)
    bits = [*"abcSTMDrevlé' '''  \n\n\t\r.,!12ß", "'s", "'re", "'LL", "'ll ", " 'tis", "don't", "\u0085", "’", "\x1f", "日", "İ", "ǅ", "́", "Σς", "½", "ª", "<|endoftext|>", "\U0001f600", "ŉ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", None, "'", "'s", "   ", " ", "a" * 5000, *thue_morse(10), *thue_morse(11), *thue_morse(12)]
    got = []
    for a, b, ids, at in bpe.encoded(pa.array(texts, pa.string()), path, spaced):
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    assert got == direct(path, [t or "" for t in texts])


def test_words_of_any_pattern_have_hashes_of_their_own():
    for letters in ("ab", "az", "xy"):
        pairs = [thue_morse(k, letters) for k in range(14)]
        texts = sorted({w for pair in pairs for w in pair})
        raw, offsets = K.utf8(pa.array([" ".join(texts)], pa.large_string()))
        hashed, start, end, _ = K.words(raw, offsets)
        assert len(set(hashed.tolist())) == len(texts) == len(start)
        again, _, _, _ = K.words(*K.utf8(pa.array(["x  " + " ".join(reversed(texts)).upper()], pa.large_string())))
        assert again[1:][::-1].tolist() == hashed.tolist()


def test_wavelet_matrix_against_numpy():
    rng = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice([0, 1, 7, 300, 50256, 65535], n).astype(np.uint32)
        m = token_store.WaveletMatrix.build(ids, 16)
        assert (m.decode() == ids).all()
        at = rng.integers(0, n, 300) if n else np.zeros(0, np.int64)
        assert (m.access(at) == ids[at]).all()
        for t in (0, 7, 50256, 4, 70000):
            assert m.count(t) == (ids == t).sum()
            assert m.occurrences(t).tolist() == np.flatnonzero(ids == t).tolist()
            if n and t < 65536:
                assert m.rank(t, np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(ids == t)]).tolist()


def test_wavelet_matrix_of_several_pages():
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.zipf(1.3, 700_000), 50_000).astype(np.uint32)
    out = io.BytesIO()
    token_store.write_shard(out, np.array([-5, 3, 9]), 1, np.array([300_000, 0, 400_000]), ids, 16)
    doc_ids, nulls, starts, m = token_store.read_shard(out.getvalue())
    assert doc_ids.tolist() == [-5, 3, 9] and nulls == 1 and starts.tolist() == [0, 300_000, 300_000, 700_000]
    at = rng.integers(0, len(ids), 2000)
    assert (m.access(at) == ids[at]).all() and (m.decode() == ids).all()
    for t in (1, 2, 77, 40_000, 50_000):
        places = np.flatnonzero(ids == t)
        assert m.occurrences(t).tolist() == places.tolist() and m.count(t, 1000, 650_000) == ((places >= 1000) & (places < 650_000)).sum()
        assert m.rank(t, at).tolist() == np.searchsorted(places, at).tolist()


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        token_store.WaveletMatrix.build(np.array([70_000]), 16)
    assert token_store.WaveletMatrix.build(np.array([70_000, 3]), 17).access(np.array([0, 1])).tolist() == [70_000, 3]


def test_files_are_smaller_than_plain_ids(spark):
    folder = token_store.new_folder(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    manifest = token_store.write_tokens(docs, folder, BYTE, 2).collect()
    size = sum(len(token_store.shard_bytes(folder, r["path"])) for r in manifest)
    assert size < 1.4 * sum(r["n_tokens"] for r in manifest)


def test_token_store_round_trip(spark, documents):
    rows = [(5, "Hello there, it's 5pm.\n\nBye"), (2, ""), (9, None), (1, "x " * 4000), (3, "日本 mixed"), (3, "again"), (None, "no id")]
    folder = token_store.new_folder(spark)
    manifest = token_store.write_tokens(documents(rows), folder, BYTE, 2, shard_tokens=3000)
    assert manifest.count() >= 3
    got = sorted(map(tuple, token_store.read_documents(manifest, folder).collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = direct(BYTE, [text or ""])[0] + [2]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    token = direct(BYTE, [" x"])[0][0]
    counts = {r["token"]: r["n"] for r in token_store.token_counts(manifest, folder, [token, 2]).collect()}
    assert counts == {token: 3999, 2: 7}


def test_token_store_of_no_rows(spark, documents):
    folder = token_store.new_folder(spark)
    manifest = token_store.write_tokens(documents([]), folder, BYTE, 2)
    assert token_store.read_documents(manifest, folder).count() == 0


def test_plan_fills_like_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(20):
        capacity = rng.choice([7, 50, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        histogram = defaultdict(int)
        for n in lengths:
            histogram[n] += 1
        rows = packing.plan(dict(histogram), capacity)
        used = defaultdict(list)
        for length, lo, hi, first, offset, copies in rows.tolist():
            for k in range(hi - lo):
                used[first + k // copies].append((offset + k % copies * length, length))
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= n]
            best = min(fits, key=lambda b: bins[b], default=None)
            if best is None:
                bins.append(capacity - n)
            else:
                bins[best] -= n
        assert len(used) == len(bins)
        assert sum(map(len, used.values())) == len(lengths)


def check_packing(rows, out, capacity):
    ids_of = {d: ids + [1] for (d, _), ids in zip(rows, direct(WORD, [t or "" for _, t in rows]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for d, ids in ids_of.items():
        got = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
    for spans in by_seq.values():
        at = 0
        for r in sorted(spans, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    total = sum(map(len, ids_of.values()))
    assert len(by_seq) <= 1.23 * -(-total // capacity) + 1


def test_packing_against_the_library(spark, documents):
    rng = random.Random(2)
    words = ["Ab", "it's", "xyzzy", "2024", "é", "...", "the"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 500])))) for k in range(300)] + [(1000, None), (1001, "w " * 9000)]
    out = packing.pack(documents(rows), WORD, 1).collect()
    check_packing(rows, out, 4096)
    assert packing.pack(documents([]), WORD, 1).count() == 0


def test_packing_of_the_table(spark, sf_dir):
    from lagpair.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(rows, QUERIES["op9_packing"](spark, sf_dir).collect(), 4096)


def test_store_of_the_table(spark, sf_dir):
    from lagpair.llm.queries import QUERIES

    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    at, want = 0, []
    for (doc_id, _), ids in zip(rows, direct(BYTE, [t or "" for _, t in rows])):
        want.append((doc_id, at, len(ids) + 1, crc(ids + [2])))
        at += len(ids) + 1
    assert sorted(map(tuple, QUERIES["op10_token_store"](spark, sf_dir).collect())) == want


def test_packing_of_repeated_and_null_ids(spark, documents):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (None, "no id"), (None, None), (2, "w " * 5000), (2, "w " * 5000)]
    out = packing.pack(documents(rows), WORD, 1).collect()
    whole = [ids + [1] for ids in direct(WORD, [t or "" for _, t in rows])]
    want = sorted(((d, k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for (d, _), ids in zip(rows, whole) for k, s in enumerate(range(0, len(ids), 4096))), key=repr)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == want
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
