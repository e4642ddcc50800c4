"""Attentive pooling with a learned query, on Arrow batches in numpy (inference: no dropout)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows whose attention is computed at a time.
ROWS = 1024


def gelu(x: np.ndarray) -> np.ndarray:
    """Exact GELU, with the error function to double precision."""
    from math import erf

    return x * 0.5 * (1 + np.vectorize(erf, otypes=[float])(x / np.sqrt(2.0)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    """Derivative of :func:`gelu`."""
    from math import erf

    return 0.5 * (1 + np.vectorize(erf, otypes=[float])(x / np.sqrt(2.0))) + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


@dataclass(frozen=True)
class AttentivePool:
    """One query attends over a text's tokens with several heads; its output passes an output projection and a GELU MLP."""

    input_dim: int
    embed_dim: int
    heads: int
    weights: dict[str, np.ndarray]

    def __post_init__(self):
        if self.embed_dim % self.heads:
            raise ValueError("embed_dim is no multiple of heads")

    @classmethod
    def fixed(cls, input_dim: int, embed_dim: int, heads: int = 8) -> AttentivePool:
        """Weights by formula, for checks."""
        shapes = {"query": (1, embed_dim), "wq": (embed_dim, embed_dim), "wk": (embed_dim, embed_dim), "wv": (embed_dim, embed_dim), "wo": (embed_dim, embed_dim), "up": (4 * embed_dim, embed_dim), "down": (embed_dim, 4 * embed_dim)}
        if input_dim != embed_dim:
            shapes["project"] = (embed_dim, input_dim)
        weights = {name: (np.arange(np.prod(s)).reshape(s) * 37 % 101 - 50) / (50 * np.sqrt(s[-1])) for name, s in shapes.items()}
        for name, n in (("bq", embed_dim), ("bk", embed_dim), ("bv", embed_dim), ("bo", embed_dim), ("up_b", 4 * embed_dim), ("down_b", embed_dim)):
            weights[name] = (np.arange(n) * 13 % 7 - 3) / 100
        return cls(input_dim, embed_dim, heads, weights)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """(rows, tokens, input_dim) to (rows, embed_dim)."""
        w, dim = self.weights, self.embed_dim // self.heads
        x = tokens @ w["project"].T if "project" in w else tokens
        split = lambda z: z.reshape(*z.shape[:-1], self.heads, dim)
        q = split(w["query"] @ w["wq"].T + w["bq"])[0]
        k, v = split(x @ w["wk"].T + w["bk"]), split(x @ w["wv"].T + w["bv"])
        z = np.einsum("hd,rthd->rht", q, k) / np.sqrt(dim)
        a = np.exp(z - z.max(axis=-1, keepdims=True))
        a /= a.sum(axis=-1, keepdims=True)
        out = np.einsum("rht,rthd->rhd", a, v).reshape(len(x), self.embed_dim) @ w["wo"].T + w["bo"]
        return gelu(out @ w["up"].T + w["up_b"]) @ w["down"].T + w["down_b"]

    def gradient(self, tokens: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient of ``weight`` times the pooled vector by every number of ``tokens``, of their shape."""
        w, dim = self.weights, self.embed_dim // self.heads
        x = tokens @ w["project"].T if "project" in w else tokens
        split = lambda z: z.reshape(*z.shape[:-1], self.heads, dim)
        q = split(w["query"] @ w["wq"].T + w["bq"])[0]
        k, v = split(x @ w["wk"].T + w["bk"]), split(x @ w["wv"].T + w["bv"])
        z = np.einsum("hd,rthd->rht", q, k) / np.sqrt(dim)
        a = np.exp(z - z.max(axis=-1, keepdims=True))
        a /= a.sum(axis=-1, keepdims=True)
        out = np.einsum("rht,rthd->rhd", a, v).reshape(len(x), self.embed_dim) @ w["wo"].T + w["bo"]
        d_up = (weight @ w["down"]) * gelu_slope(out @ w["up"].T + w["up_b"])
        d_heads = split(d_up @ w["up"] @ w["wo"])
        d_a = np.einsum("rthd,rhd->rht", v, d_heads)
        d_z = a * (d_a - (a * d_a).sum(axis=-1, keepdims=True))
        d_k = np.einsum("rht,hd->rthd", d_z, q) / np.sqrt(dim)
        d_v = np.einsum("rht,rhd->rthd", a, d_heads)
        whole = lambda g: g.reshape(*g.shape[:2], self.embed_dim)
        d_x = whole(d_k) @ w["wk"] + whole(d_v) @ w["wv"]
        return d_x @ w["project"] if "project" in w else d_x

    def pooled(self, flat: Column) -> Column:
        """Pools a column of flat vectors; a null, or a vector that is no whole number of tokens, gives null."""
        return self._applied(flat, lambda x: self(x))

    def saliency(self, flat: Column, weight: list[float], before: bool = False) -> Column:
        """Gradient of a linear head's logit by a pair's flat vector, pooled here: the after side, or the before side, whose
        sign is the other."""
        row = np.array(weight, dtype=np.float64) * (-1 if before else 1)
        return self._applied(flat, lambda x: self.gradient(x, row).reshape(len(x), -1))

    def _applied(self, flat: Column, of: Callable[[np.ndarray], np.ndarray]) -> Column:
        width = self.input_dim

        @F.pandas_udf("array<double>")
        def apply(column: pd.Series) -> pd.Series:
            rows = column.to_numpy()
            sizes = np.array([0 if x is None else len(x) for x in rows], dtype=np.int64)
            out = np.full(len(rows), None, dtype=object)
            for size in np.unique(sizes[(sizes > 0) & (sizes % width == 0)]).tolist():
                mine = np.flatnonzero(sizes == size)
                for s in range(0, len(mine), ROWS):
                    part = mine[s : s + ROWS]
                    x = np.stack(rows[part]).astype(np.float64).reshape(len(part), size // width, width)
                    for i, v in zip(part.tolist(), of(x)):
                        out[i] = v
            return pd.Series(out)

        return apply(flat)


@dataclass(frozen=True)
class MlpHead:
    """The MLP head: twice as many hidden units as inputs, GELU between (inference: no dropout)."""

    hidden: np.ndarray
    hidden_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray

    @classmethod
    def fixed(cls, dim: int, classes: int = 2) -> MlpHead:
        """Weights by formula, for checks."""
        weight = lambda a, b: (np.arange(a * b).reshape(a, b) * 37 % 101 - 50) / (50 * np.sqrt(b))
        bias = lambda n: (np.arange(n) * 13 % 7 - 3) / 100
        return cls(weight(2 * dim, dim), bias(2 * dim), weight(classes, 2 * dim), bias(classes))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, inputs) to (rows, classes)."""
        return gelu(x @ self.hidden.T + self.hidden_b) @ self.out.T + self.out_b

    def logits(self, x: Column) -> Column:
        """Logits of a column of vectors; a null, or a vector of another length, has none."""
        head = self

        @F.pandas_udf("array<double>")
        def apply(column: pd.Series) -> pd.Series:
            rows = column.to_numpy()
            out = np.full(len(rows), None, dtype=object)
            fit = np.array([v is not None and len(v) == head.hidden.shape[1] for v in rows], dtype=bool)
            for s in range(0, int(fit.sum()), ROWS):
                part = np.flatnonzero(fit)[s : s + ROWS]
                for i, v in zip(part.tolist(), head(np.stack(rows[part]).astype(np.float64))):
                    out[i] = v
            return pd.Series(out)

        return apply(x)
