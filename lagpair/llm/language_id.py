"""Language identification with hyperdimensional profiles.

Each letter has a random vector of ``dims`` entries +1 and -1, drawn from a
seed. An n-gram's vector is the product of its letters' vectors, each permuted
(rolled) by its place in the gram; a text's vector is the sum over its grams.
A language's prototype is the sum over all its training texts, so it is learnt
by adding partial sums. A text gets the language of the prototype with the
largest cosine; the score is that cosine, or 0 where it is negative.

Grams run over lower-cased letters; each run of other characters is one
boundary letter, as is each end of a text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if there is nothing to learn from. Ties go to the language that sorts
first. Texts of rows without a language are predicted, never learnt from.
Repeated rows each give a row and each count in training. Columns other than
doc_id, text and lang are ignored.

A text is in none of the languages if, for each, its cosine lies surely under
what a text of as many grams has on average in that language. That average is
the profile's own: two grams drawn from the training texts are equal with a
known probability. A short text's average is within the noise of random vectors,
so it is never rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagpair.llm import textkit as K
from lagpair.llm.common import fold, small_batches, text_rows

DIMS = 1024
GRAM = 3
#: Letters are hashed to so many vectors; 0 is the boundary.
LETTERS = 4096
UNKNOWN = "und"
#: Share of a language's average cosine under which a text is not in it, and the deviations of random cosines that it must be under it.
SHARE, DEVIATIONS = 0.5, 5
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def _tables() -> dict:
    kept = K.cache()
    if "letter slots" not in kept:
        slots = np.zeros(0x110000, dtype=np.uint16)
        for cp in range(0x20000):
            c = chr(cp)
            if c.isalpha():
                slots[cp] = 1 + (ord(c.lower()[0]) * 40503 >> 4) % (LETTERS - 1)
        slots[0x20000:0x32000] = 1 + (np.arange(0x20000, 0x32000) * 40503 >> 4) % (LETTERS - 1)
        kept["letter slots"] = slots
    return kept


def letter_vectors(dims: int) -> np.ndarray:
    kept = _tables()
    if f"letters {dims}" not in kept:
        kept[f"letters {dims}"] = np.random.Generator(np.random.PCG64(4242)).choice(np.array([-1, 1], np.int8), (LETTERS, dims))
    return kept[f"letters {dims}"]


def gram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    """Vectors of grams given as numbers of 12 bits a letter, the first letter highest."""
    letters = letter_vectors(dims)
    out = None
    for place in range(GRAM):
        letter = (grams >> np.uint64(12 * (GRAM - 1 - place))).astype(np.int64) & 0xFFF
        bound = np.roll(letters[letter], GRAM - 1 - place, axis=1)
        out = bound if out is None else out * bound
    return out.astype(np.float32)


def gram_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, gram and count of each distinct gram of each text, ordered by row; and which texts have a letter."""
    if len(offsets) != 2 or len(raw) <= 2 * K.CHUNK_BYTES:
        return _gram_counts(raw, offsets)
    # cut at blanks between letters: what the parts lack is the gram of the two letters and the boundary between them
    slots, grams, counts, at, has = _tables()["letter slots"], [], [], 0, np.zeros(1, dtype=bool)
    for end in K.parts(raw, K.lone_blanks(raw, K.ASCII_LETTER)):
        _, gram, count, some = _gram_counts(raw[at:end], np.array([0, end - at]))
        grams.append(gram)
        counts.append(count)
        has |= some
        if end < len(raw):
            grams.append(np.array([int(slots[raw[end - 1]]) << 24 | int(slots[raw[end + 1]])], np.uint64))
            counts.append(np.ones(1, np.int64))
        at = end + 1
    gram, place = np.unique(np.concatenate(grams), return_inverse=True)
    return np.zeros(len(gram), np.int64), gram, np.bincount(place, np.concatenate(counts), len(gram)).astype(np.int64), has


def _gram_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    text = raw.tobytes().decode("utf-8")
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = offsets if len(cps) == len(raw) else np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    slots = _tables()["letter slots"][cps]
    row = np.repeat(np.arange(rows), np.diff(at))
    keep = slots > 0
    keep[1:] |= (slots[:-1] > 0) & (row[1:] == row[:-1])  # the first of each run of others ends the letters before it
    first = np.zeros(len(slots), dtype=bool)
    first[at[:-1][at[1:] > at[:-1]]] = True
    keep &= (slots > 0) | ~first
    slots, row = slots[keep].astype(np.uint64), row[keep]
    has = np.bincount(row, minlength=rows) > 0
    # a boundary before each text and one after it
    counts = np.bincount(row, minlength=rows)
    padded = np.zeros(len(slots) + 2 * rows, dtype=np.uint64)
    padded[np.arange(len(slots)) + 2 * row + 1] = slots
    width = counts + 2
    ends = np.cumsum(width)
    prow = np.repeat(np.arange(rows), width)
    n = len(padded) - GRAM + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, has
    key = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        key = (key << np.uint64(12)) | padded[k : k + n]
    inside = (np.arange(n) + GRAM <= ends[prow[:n]]) & has[prow[:n]]
    key = key[inside] | (prow[:n][inside].astype(np.uint64) << np.uint64(12 * GRAM))
    key.sort()
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, has
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(begin, len(key)))
    key = key[begin]
    return (key >> np.uint64(12 * GRAM)).astype(np.int64), key & np.uint64((1 << 12 * GRAM) - 1), count, has


def text_vectors(raw: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of each text, and which texts have a letter."""
    return sized_vectors(raw, offsets, dims)[:2]


def sized_vectors(raw: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with each text's number of grams over the norm of its counts: the root of its number of grams if they all differ."""
    row, gram, count, has = gram_counts(raw, offsets)
    rows = len(offsets) - 1
    size = np.bincount(row, weights=count, minlength=rows) / np.sqrt(np.maximum(np.bincount(row, weights=count.astype(np.float64) ** 2, minlength=rows), 1))
    out = np.zeros((rows, dims), dtype=np.float32)
    distinct, place = np.unique(gram, return_inverse=True)
    for low in range(0, len(distinct), 16384):  # a part of the grams at a time, which bounds the memory
        vectors = gram_vectors(distinct[low : low + 16384], dims)
        mine = (place >= low) & (place < low + len(vectors))
        r, p, c = row[mine], place[mine] - low, count[mine].astype(np.float32)
        bounds = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1], [True]])) if len(r) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            for s in range(a, b, 8192):
                e = min(s + 8192, b)
                out[r[a]] += c[s:e] @ vectors[p[s:e]]
    return out, has, size


def _bundled(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    grams: dict[str, float] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for a, b, raw, offsets in K.chunks(batch.column("text")):
            row, gram, count, _ = gram_counts(raw, offsets)
            for lang in set(langs[a:b].tolist()):
                mine = (langs[a:b] == lang)[row]
                distinct, place = np.unique(gram[mine], return_inverse=True)
                totals = np.bincount(place, weights=count[mine], minlength=len(distinct))
                into = sums.setdefault(lang, np.zeros(dims))
                grams[lang] = grams.get(lang, 0) + totals.sum()
                for low in range(0, len(distinct), 16384):
                    into += totals[low : low + 16384].astype(np.float32) @ gram_vectors(distinct[low : low + 16384], dims)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (dims + 1), pa.string()), pa.array(np.arange(dims + 1), pa.int32()), pa.array(np.rint(np.append(total, grams[lang])).astype(np.int64))], names=["lang", "dim", "v"])


def learnt(docs: DataFrame, train: Column, dims: int = DIMS) -> dict[str, tuple[np.ndarray, float]]:
    """For every language of the training rows, its prototype and the average cosine, by :func:`sized_vectors`' size, of a text in it.

    What comes to the driver is ``dims`` numbers a language and its number of grams.
    """
    small_batches(docs.sparkSession)
    rows = text_rows(docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()), "lang", "text")
    sums = rows.mapInArrow(lambda b: _bundled(b, dims), "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(dims + 1))[r["dim"]] = r["v"]
    return {lang: (v[:-1] / np.linalg.norm(v[:-1]), _average(np.linalg.norm(v[:-1]) / np.sqrt(dims), v[-1])) for lang, v in sorted(out.items()) if v[:-1].any()}


def _average(norm: float, grams: float) -> float:
    """Average weight in a profile of a gram of its language: pairs of equal grams in the training texts, a gram with itself left out."""
    return max(0.0, (norm**2 - grams) / (norm * max(grams - 1, 1)))


def prototypes(docs: DataFrame, train: Column, dims: int = DIMS) -> dict[str, np.ndarray]:
    """Prototype of every language of the training rows."""
    return {lang: vector for lang, (vector, _) in learnt(docs, train, dims).items()}


def _predicted(batches: Iterator[pa.RecordBatch], names: list[str], profiles: np.ndarray, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        best, score = np.full(n, -1), np.zeros(n)
        for a, b, raw, offsets in K.chunks(batch.column("text")) if len(names) else []:
            vectors, has = text_vectors(raw, offsets, dims)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = (vectors @ profiles.T) / np.maximum(norms, 1e-9)[:, None]
            top = np.argmax(cosines, axis=1)
            best[a:b] = np.where(has, top, -1)
            score[a:b] = np.where(has, np.clip(cosines[np.arange(b - a), top], 0, 1), 0)
        langs = pa.array([names[k] if k >= 0 else UNKNOWN for k in best], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), langs, pa.array(score.astype(np.float64))], names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], dims: int = DIMS) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    small_batches(docs.sparkSession)
    names = list(profiles)
    matrix = np.array([profiles[k] for k in names], dtype=np.float32).reshape(-1, dims)
    return text_rows(docs, "doc_id", "text").mapInArrow(lambda b: _predicted(b, names, matrix, dims), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held: int = 0, dims: int = DIMS) -> DataFrame:
    """Learns from the rows out of the held fold and predicts all."""
    profiles = prototypes(docs, fold("doc_id", folds) != held, dims)
    return predict(docs, profiles, dims).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")


def _accepted(batches: Iterator[pa.RecordBatch], profiles: np.ndarray, average: np.ndarray, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for a, b, raw, offsets in K.chunks(batch.column("text")):
            vectors, has, size = sized_vectors(raw, offsets, dims)
            cosines = (vectors @ profiles.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
            least = SHARE * size[:, None] * average - DEVIATIONS / np.sqrt(dims)
            keep[a:b] = has & (cosines >= least).any(axis=1)
        yield batch.filter(pa.array(keep))


def keep_identified(docs: DataFrame, languages: dict[str, tuple[np.ndarray, float]], dims: int = DIMS) -> DataFrame:
    """Rows of ``docs`` whose text has a letter and may be in one of the languages of :func:`learnt`; all columns stay.

    Without a language to learn from all rows stay.
    """
    if not languages:
        return docs
    small_batches(docs.sparkSession)
    matrix = np.array([vector for vector, _ in languages.values()], dtype=np.float32)
    average = np.array([mean for _, mean in languages.values()])
    return docs.mapInArrow(lambda b: _accepted(b, matrix, average, dims), docs.schema)
