"""Pooling, deltas and heads over arrays, inside whole-stage plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POOLS = ("mean", "max", "concat", "none")


def tokens(flat: Column, dim: int) -> Column:
    """A flat vector as its tokens of ``dim`` numbers each."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / F.lit(dim)).cast("int") - 1), lambda t: F.slice(flat, t * dim + 1, dim).cast("array<double>"))


def pool_mean(toks: Column) -> Column:
    """Mean over tokens, dimension by dimension."""
    total = F.aggregate(F.slice(toks, 2, F.size(toks)), F.get(toks, F.lit(0)), lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(toks))


def pool_max(toks: Column) -> Column:
    return F.aggregate(F.slice(toks, 2, F.size(toks)), F.get(toks, F.lit(0)), lambda acc, t: F.zip_with(acc, t, lambda a, b: F.greatest(a, b)))


def pool(toks: Column, kind: str) -> Column:
    """Pools tokens: mean, max, concat (token by token) or none (as concat, but not reduced)."""
    if kind not in POOLS:
        raise ValueError(f"pool is {kind!r}, not one of {POOLS}")
    return {"mean": pool_mean, "max": pool_max}.get(kind, F.flatten)(toks)


def delta(before: Column, after: Column) -> Column:
    """after - before; what is swapped changes its sign."""
    return F.zip_with(after, before, lambda a, b: a.cast("double") - b.cast("double"))


def dot(x: Column, weights: list[float]) -> Column:
    """Dot product with constant weights, summed from the left."""
    row = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(x, row, lambda a, w: a.cast("double") * w), F.lit(0.0), lambda acc, p: acc + p)


def linear_head(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Logits of a linear head as an array."""
    return F.array(*[dot(x, w) + F.lit(float(b)) for w, b in zip(weights, bias)])


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x))


def argmax(logits: Column) -> Column:
    """Place (from 0) of the first largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("long")


def cross_entropy(logits: Column, label: Column) -> Column:
    """log-sum-exp of the logits less the label's own."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
    return F.log(total) + top - F.get(logits, label.cast("int"))


def mean_pool_gradient(weights: list[float], n_tokens: int, before: bool = False) -> list[list[float]]:
    """Gradient of one logit by each input number for a mean pool, a delta and a linear head."""
    sign = -1.0 if before else 1.0
    return [[sign * w / n_tokens for w in weights] for _ in range(n_tokens)]
