"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes.

Features are the distinct n-grams of 4 to 6 characters of a lower-cased text,
hashed to ``2 ** bits`` places. Each is scaled by its naive Bayes log-count
ratio, log of its smoothed share among toxic texts over that among the others.
A logistic regression with an L2 penalty is fitted on the scaled features.

A rare n-gram has a large ratio by chance, and a model that uses it learns its
few texts by heart. So only n-grams have a weight whose ratio is ``LEAST_RATIO``
or more in either direction and ``LEAST_Z`` of its own standard errors away from
0, ``MAX_FEATURES`` of them at most, the surest ones.

The intercept is set by cross-validation among the training rows: ``INNER``
models, each without a part of them, score that part. The cut on these scores
that does best (share of toxic texts found less ``FALSE_COST`` times the share of
others marked, with at most ``MOST_FALSE`` of the others marked) is given the
score ``threshold``.

The fit uses at most ``max_labelled`` labelled rows, those with the least hash
of their id; a hash does not favour any. What comes to the driver is the counts
of the chosen features and a bit for each row and feature: ``max_labelled *
MAX_FEATURES / 8`` bytes, 41 MB, at most.

Edge cases: a null or empty text is scored like any other, by the intercept.
Without labels of both classes every score is 0; with too few rows for the
cross-validation the intercept stays as fitted. Repeated labels of one doc_id
count once, as toxic if any is. Null labels and ids are ignored. Rows that
repeat a doc_id each count and are each scored. Columns other than doc_id, text
and toxic are ignored. Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagpair.llm import textkit as K
from lagpair.llm.common import discard, fold, small_batches, stored, text_rows

BITS = 20
SIZES = (4, 5, 6)
MAX_LABELLED = 20_000
LEAST_ROWS = 3
LEAST_RATIO = 1.0
LEAST_Z = 3.5
MAX_FEATURES = 16_384
PENALTY = 1.0
THRESHOLD = 0.7
#: Parts of the training rows, each scored by a model of the others to set the intercept.
INNER = 5
MOST_FALSE, FALSE_COST = 0.02, 1.0


def _lower_table() -> np.ndarray:
    kept = K.cache()
    if "lower" not in kept:
        table = np.arange(0x10000, dtype=np.uint32)
        for cp in range(0x10000):
            c = chr(cp)
            if c.isspace():
                table[cp] = 32
            elif c.isupper() and len(c.lower()) == 1:
                table[cp] = ord(c.lower())
        kept["lower"] = table
    return kept["lower"]


def grams(raw: np.ndarray, offsets: np.ndarray, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the distinct n-grams of each text, of those alone that ``wanted`` marks; ordered by row."""
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if rows == 1 and len(raw) > 2 * K.CHUNK_BYTES:
        # a part begins behind a blank and ends before one, and goes back far enough to hold what the last one's end cuts
        blank = raw == 32
        places, found, at = np.flatnonzero(blank), [], 0
        for end in K.parts(raw, blank):
            found.append(_grams(raw[at:end], np.array([0, end - at]), bits, wanted)[1])
            k = int(np.searchsorted(places, end - 4 * max(SIZES), side="right")) - 1
            at = int(places[k]) + 1 if k >= 0 else 0
        place = np.unique(np.concatenate(found))
        return np.zeros(len(place), np.int64), place
    return _grams(raw, offsets, bits, wanted)


def _grams(raw: np.ndarray, offsets: np.ndarray, bits: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    text = raw.tobytes().decode("utf-8")
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = offsets if len(cps) == len(raw) else np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    cps = np.where(cps < 0x10000, _lower_table()[np.minimum(cps, 0xFFFF)], cps)
    # a blank around each text
    width = np.diff(at) + 2
    ends = np.cumsum(width)
    row = np.repeat(np.arange(rows), width)
    padded = np.full(len(cps) + 2 * rows, 32, dtype=np.uint64)
    padded[np.arange(len(cps)) + 2 * np.repeat(np.arange(rows), np.diff(at)) + 1] = cps
    found = []
    acc = padded.copy()
    for size in range(2, max(SIZES) + 1):
        n = len(padded) - size + 1
        if n <= 0:
            break
        acc = acc[:n] * np.uint64(0x100000001B3) + padded[size - 1 :]
        if size not in SIZES:
            continue
        place = (K.mix(acc + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64)
        inside = np.arange(n) + size <= ends[row[:n]]
        if wanted is not None:
            inside &= wanted[place]
        found.append((row[:n][inside] << bits) | place[inside])
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key >> bits, key & ((1 << bits) - 1)


def _class_counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of each kind (twice the part, one more if toxic) that hold each place, chunk by chunk; place -1 counts all rows."""
    for batch in batches:
        kind = 2 * batch.column("part").to_numpy().astype(np.int64) + batch.column("toxic").to_numpy()
        for a, b, raw, offsets in K.chunks(batch.column("text")):
            row, place = grams(raw, offsets, bits)
            key, n = np.unique(kind[a + row] << bits | place, return_counts=True)
            of, rows = np.unique(kind[a:b], return_counts=True)
            places, kinds, counts = np.append(key & ((1 << bits) - 1), np.full(len(of), -1)), np.append(key >> bits, of), np.append(n, rows)
            for s in range(0, len(places), EMITTED):
                yield pa.RecordBatch.from_arrays([pa.array(x[s : s + EMITTED].astype(np.int32)) for x in (places, kinds, counts)], names=["place", "kind", "n"])


#: Rows without (n) and with (t) a toxic label in each part.
COUNTS = [f"{y}{k}" for k in range(INNER) for y in "nt"]
#: Rows of a batch of counts.
EMITTED = 1 << 16


def ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each place, and by how many of its standard errors it is off 0."""
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    error = np.sqrt(np.maximum(1 / (toxic + 1) - 1 / (n_toxic + 2) + 1 / (clean + 1) - 1 / (n_clean + 2), 1e-12))
    return ratio, np.abs(ratio) / error


def used(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """The ratio of each place that has a weight, 0 of the others."""
    ratio, z = ratios(clean, toxic, n_clean, n_toxic)
    return np.where((clean + toxic >= LEAST_ROWS) & (np.abs(ratio) >= LEAST_RATIO) & (z >= LEAST_Z), ratio, 0.0)


def _surest(counts: DataFrame, total: np.ndarray) -> DataFrame:
    """Counts of the places that may have a weight in the model of all parts or in one that leaves a part out."""
    sure = []
    for left_out in (None, *range(INNER)):
        parts = [k for k in range(INNER) if k != left_out]
        (clean, n), (toxic, m) = ((sum((F.col(f"{y}{k}") for k in parts), F.lit(0)), float(sum(total[2 * k + i] for k in parts))) for i, y in enumerate("nt"))
        ratio = F.log((toxic + 1) / (m + 2)) - F.log((clean + 1) / (n + 2))
        error = F.sqrt(F.greatest(1 / (toxic + 1) - 1 / (m + 2) + 1 / (clean + 1) - 1 / (n + 2), F.lit(1e-12)))
        sure.append(F.when((clean + toxic >= LEAST_ROWS) & (F.abs(ratio) >= 0.999 * LEAST_RATIO), F.abs(ratio) / error).otherwise(0.0))
    rows = counts.where("place >= 0").withColumn("z", F.greatest(*sure)).where(F.col("z") >= 0.999 * LEAST_Z)
    return rows.orderBy(F.desc("z"), "place").limit(MAX_FEATURES)


def _vectors(batches: Iterator[pa.RecordBatch], bits: int, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    wanted = np.zeros(1 << bits, dtype=bool)
    wanted[places] = True
    for batch in batches:
        for a, b, raw, offsets in K.chunks(batch.column("text")):
            row, place = grams(raw, offsets, bits, wanted)
            held = []
            for s, e in zip(*(np.searchsorted(row, np.arange(b - a) + k) for k in (0, 1))):
                bit = np.zeros(len(places), dtype=bool)
                bit[np.searchsorted(places, place[s:e])] = True
                held.append(np.packbits(bit).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), batch.column("part").slice(a, b - a), pa.array(held, pa.binary())], names=["toxic", "part", "bits"])


def _minimise(loss, start: np.ndarray, steps: int = 80, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking."""
    x = start.copy()
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y, rho in reversed(past):
            alphas.append(rho * s.dot(d))
            d = d - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            d *= s.dot(y) / y.dot(y)
        for (s, y, rho), alpha in zip(past, reversed(alphas)):
            d = d + (alpha - rho * y.dot(d)) * s
        slope, step = g.dot(d), 1.0 if past else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        if slope > -1e-10:
            break
        while True:
            nf, ng = loss(x + step * d)
            if nf <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = step * d, ng - g
        x, small = x + s, f - nf < 1e-7 * max(1.0, abs(f))
        f, g = nf, ng
        if s.dot(y) > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1.0 / s.dot(y))]
        if small:
            break
    return x


def fit_weights(ratio: np.ndarray, rows: list[np.ndarray], y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights by feature (regression weight times ratio) and the intercept; a row is the features it has."""
    have = np.flatnonzero(ratio)
    column = np.full(len(ratio), -1)
    column[have] = np.arange(len(have))
    index = column[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(p) for p in rows])[index >= 0]
    index = index[index >= 0]
    scale = ratio[have]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, (x[:-1] * scale)[index], len(rows)) + x[-1]
        f = np.mean(np.logaddexp(0, z) - y * z) + penalty / len(rows) * x[:-1].dot(x[:-1]) / 2
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(rows)
        grad = np.bincount(index, e[owner], len(have)) * scale + penalty / len(rows) * x[:-1]
        return f, np.append(grad, e.sum())

    x = _minimise(loss, np.append(np.zeros(len(have)), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))))
    weights = np.zeros(len(ratio))
    weights[have] = x[:-1] * scale
    return weights, float(x[-1])


def best_cut(z: np.ndarray, y: np.ndarray) -> float | None:
    """The cut of highest worth on scores of rows that their model has not seen; None if they are too few for any.

    Two marked rows are added to the others', so that a cut's share of them is not taken for small on little evidence.
    """
    clean, toxic = np.sort(z[y == 0]), np.sort(z[y == 1])
    cuts = np.unique(z)
    false = (len(clean) - np.searchsorted(clean, cuts)) / len(clean)
    found = (len(toxic) - np.searchsorted(toxic, cuts)) / len(toxic)
    bound = (len(clean) * false + 2) / (len(clean) + 2)
    worth = np.where(bound <= MOST_FALSE, found - FALSE_COST * false, -1.0)
    best = int(np.argmax(worth))
    if worth[best] <= 0:
        return None
    below = cuts[best - 1] if best else cuts[best] - 1.0
    return float(cuts[best] + below) / 2


def fit(docs: DataFrame, labels: DataFrame, train: Column, bits: int = BITS, max_labelled: int = MAX_LABELLED, penalty: float = PENALTY, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Places, their weights and the intercept; None without rows of both classes."""
    small_batches(docs.sparkSession)
    known = labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(INNER)).cast("int")
    rows = stored(text_rows(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", part.alias("part"), "text"), "labelled")
    by_kind = rows.mapInArrow(lambda b: _class_counts(b, bits), "place int, kind int, n int").groupBy("place")
    counts = stored(by_kind.agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(COUNTS))), "gram-counts")
    head = counts.where("place = -1").first()
    total = np.array([head[c] for c in COUNTS]) if head else np.zeros(2 * INNER, np.int64)
    if not total[0::2].any() or not total[1::2].any():
        discard(rows, counts)
        return None
    table = _surest(counts, total).orderBy("place").toArrow()
    places = table.column("place").to_numpy()
    sums = np.stack([table.column(c).to_numpy() for c in COUNTS])
    got = rows.mapInArrow(lambda b: _vectors(b, bits, places), "toxic int, part int, bits binary").toArrow()
    y, parts = got.column("toxic").to_numpy(), got.column("part").to_numpy()
    features = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), count=len(places))) for b in got.column("bits").to_pylist()]
    discard(rows, counts)

    def model(mine: np.ndarray) -> tuple[np.ndarray, float]:
        among = np.isin(parts, mine)
        (clean, n), (toxic, m) = ((sums[2 * mine + i].sum(axis=0), total[2 * mine + i].sum()) for i in (0, 1))
        return fit_weights(used(clean, toxic, n, m), [features[r] for r in np.flatnonzero(among)], y[among].astype(float), penalty)

    unseen = np.full(len(y), np.nan)
    for k in range(INNER):
        mine = np.array([p for p in range(INNER) if p != k])
        if total[2 * mine].any() and total[2 * mine + 1].any():
            weights, intercept = model(mine)
            for r in np.flatnonzero(parts == k):
                unseen[r] = weights[features[r]].sum() + intercept
    weights, intercept = model(np.arange(INNER))
    scored = ~np.isnan(unseen)
    cut = best_cut(unseen[scored], y[scored]) if len(np.unique(y[scored])) == 2 else None
    if cut is not None:
        intercept += float(np.log(threshold / (1 - threshold))) - cut
    have = np.flatnonzero(weights)
    return places[have], weights[have], intercept


def _scored(batches: Iterator[pa.RecordBatch], bits: int, place: np.ndarray, value: np.ndarray, intercept: float) -> Iterator[pa.RecordBatch]:
    weights = np.zeros(1 << bits)
    weights[place] = value
    wanted = weights != 0
    for batch in batches:
        z = np.full(batch.num_rows, intercept)
        for a, b, raw, offsets in K.chunks(batch.column("text")):
            row, found = grams(raw, offsets, bits, wanted)
            z[a:b] += np.bincount(row, weights[found], b - a)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, bits: int = BITS) -> DataFrame:
    """doc_id and score of every row."""
    small_batches(docs.sparkSession)
    rows = text_rows(docs, "doc_id", "text")
    if model is None:
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    place, value, intercept = model
    return rows.mapInArrow(lambda b: _scored(b, bits, place, value, intercept), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Fits on the labelled rows out of the held fold and scores all documents."""
    scored = score(docs, fit(docs, labels, fold("doc_id", folds) != held, threshold=threshold))
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
