"""Texts that hold a tokenizer's added tokens get the ids that the library gives by default."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lagpair.llm import bpe, packing, token_store

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_added_tokens_are_ids(path, spaced):
    rng = random.Random(8)
    bits = ["one", " ", "Two", "é", "日", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "\n", ""]
    texts = ["one <|endoftext|> two", "", "<|endoftext|>", None] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    got = []
    for a, b, ids, at in bpe.encoded(pa.array(texts, pa.string()), path, spaced):
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    assert got == library(path, [t or "" for t in texts])


def test_operators_give_the_ids_of_added_tokens(spark, documents):
    rows = [(1, "one <|endoftext|> two"), (2, "plain"), (3, "<|startoftext|>x<|endoftext|>")]
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    words = [ids + [1] for ids in library(WORD, [t for _, t in rows])]
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(documents(rows), WORD, 1).collect()}
    assert packed == {d: (len(ids), crc(ids)) for (d, _), ids in zip(rows, words)}
    folder = token_store.new_folder(spark)
    manifest = token_store.write_tokens(documents(rows), folder, BYTE, 2)
    at, want = 0, []
    for (doc_id, _), ids in zip(rows, library(BYTE, [t for _, t in rows])):
        want.append((doc_id, at, len(ids) + 1, crc(ids + [2])))
        at += len(ids) + 1
    assert sorted(map(tuple, token_store.read_documents(manifest, folder).collect())) == want
