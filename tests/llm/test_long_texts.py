"""A text that is cut inside gives what it gives as a whole."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lagpair.llm import bpe, language_id, toxicity
from lagpair.llm import textkit as K

BITS = ["word", "Two", "a", "é", "日本", "don't", "1999", "...", "ünï", "x-y", "<|endoftext|>", "\u00a0", "Σς"]
GAPS = [" ", " ", " ", "  ", "\n", " \n", "\t", ""]


def texts():
    rng = random.Random(12)
    out = ["".join(rng.choice(BITS) + rng.choice(GAPS) for _ in range(rng.choice([300, 900]))) for _ in range(25)]
    return out + ["a" * 3000, " " * 3000, "é" * 2000, "ab " * 1500, "a\n" * 1500, " " + "word " * 700, "x" * 700 + " y" * 400]


def both(monkeypatch, of):
    """What ``of`` gives for each text, whole and cut into parts of 128 bytes."""
    whole = [of(t) for t in texts()]
    monkeypatch.setattr(K, "CHUNK_BYTES", 128)
    return zip(whole, [of(t) for t in texts()])


def array(text):
    return K.utf8(pa.array([text], pa.large_string()))


@pytest.mark.parametrize("inside", [K.SPACED, K.ALNUM])
def test_words(monkeypatch, inside):
    for a, b in both(monkeypatch, lambda t: (*K.words(*array(t), inside), K.word_counts(*array(t), inside))):
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(a, b))


def test_words_of_several_rows(monkeypatch):
    raw, offsets = K.utf8(pa.array(texts(), pa.large_string()))
    whole = K.words(raw, offsets)
    monkeypatch.setattr(K, "CHUNK_BYTES", 128)
    assert all((x == y).all() for x, y in zip(whole, K.words(raw, offsets)))


@pytest.mark.parametrize("file,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids(monkeypatch, file, spaced):
    def ids(text):
        ((_, _, got, bounds),) = bpe.encoded(pa.array([text], pa.large_string()), public_tokenizers.path(file), spaced)
        return got.tolist(), bounds.tolist()

    for a, b in both(monkeypatch, ids):
        assert a == b


def test_grams(monkeypatch):
    for a, b in both(monkeypatch, lambda t: toxicity.grams(*array(t), 30)):
        assert (a[1] == b[1]).all() and len(a[0]) == len(b[0])


def test_language_vectors(monkeypatch):
    for a, b in both(monkeypatch, lambda t: (*language_id.gram_counts(*array(t)), *language_id.sized_vectors(*array(t), 64))):
        assert all(np.allclose(x, y) and len(x) == len(y) for x, y in zip(a, b))
