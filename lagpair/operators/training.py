"""Training the heads on deltas, and projecting deltas to two dimensions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagpair.operators.attention import MlpHead, gelu, gelu_slope
from lagpair.sources.shared import discard, stored

HEADS = ("linear", "mlp")
LEARNING_RATE, WEIGHT_DECAY = 1e-5, 5e-4


def fit_head(rows: DataFrame, kind: str = "linear", max_iter: int = 100, seed: int = 42):
    """Fits a head on (x array, label). The linear head is a logistic regression; the MLP has twice as many hidden units as
    inputs and, unlike the model it stands for, a sigmoid between; :class:`AdamW` fits the one with GELU."""
    if kind not in HEADS:
        raise ValueError(f"head is {kind!r}, not one of {HEADS}")
    data = rows.select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    if kind == "linear":
        return LogisticRegression(maxIter=max_iter, regParam=WEIGHT_DECAY).fit(data)
    n = data.first()["features"].size
    return MultilayerPerceptronClassifier(layers=[n, 2 * n, 2], maxIter=max_iter, seed=seed).fit(data)


def apply_head(model, rows: DataFrame) -> DataFrame:
    """Adds p1, the probability of class 1, and pred."""
    scored = model.transform(rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>"))))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("p1"), F.col("prediction").cast("long").alias("pred"))


class LogisticModel:
    """One logit of x: weights, bias last."""

    def __init__(self, dim: int):
        self.dim = dim

    def start(self, seed: int) -> np.ndarray:
        return np.zeros(self.dim + 1)

    def loss(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over the rows of the loss and of its gradient."""
        x = np.column_stack([x, np.ones(len(x))])
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z)), x.T @ (1 / (1 + np.exp(-z)) - y)


class MlpModel:
    """The MLP head of two classes: twice as many hidden units as inputs, GELU between; cross-entropy of the softmax."""

    def __init__(self, dim: int):
        self.dim = dim
        self.shapes = [(2 * dim, dim), (2 * dim,), (2, 2 * dim), (2,)]

    def parts(self, w: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [p.reshape(s) for p, s in zip(np.split(w, ends[:-1]), self.shapes)]

    def start(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of a unit's inputs."""
        rng = np.random.default_rng(seed)
        fan = [self.dim, self.dim, 2 * self.dim, 2 * self.dim]
        return np.concatenate([rng.uniform(-1, 1, int(np.prod(s))) / np.sqrt(n) for s, n in zip(self.shapes, fan)])

    def head(self, w: np.ndarray) -> MlpHead:
        return MlpHead(*self.parts(w))

    def loss(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        hidden, hidden_b, out, out_b = self.parts(w)
        u = x @ hidden.T + hidden_b
        g = gelu(u)
        z = g @ out.T + out_b
        z = z - z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        rows, label = np.arange(len(x)), y.astype(int)
        d_z = np.exp(log_p)
        d_z[rows, label] -= 1
        d_u = (d_z @ out) * gelu_slope(u)
        return float(-log_p[rows, label].sum()), np.concatenate([(d_u.T @ x).ravel(), d_u.sum(axis=0), (d_z.T @ g).ravel(), d_z.sum(axis=0)])


MODELS = {"linear": LogisticModel, "mlp": MlpModel}


@dataclass
class AdamW:
    """A head by AdamW: each step is one distributed pass that sums the gradient by task, so only numbers of the head's size
    reach the driver. With ``batches`` over 1 a step takes one of so many parts of the rows, dealt by hash, in turn."""

    rate: float = LEARNING_RATE
    decay: float = WEIGHT_DECAY
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    batches: int = 1
    seed: int = 42

    def fit(self, rows: DataFrame, steps: int = 20, kind: str = "linear") -> tuple[np.ndarray, list[float]]:
        """Weights and the loss before each step, for rows of (x array, label). Rows without either are left out; those whose x
        is of another length than the first are an error."""
        if kind not in MODELS:
            raise ValueError(f"head is {kind!r}, not one of {tuple(MODELS)}")
        data = rows.where("x is not null and label is not null").select(F.col("x").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
        first = data.first()
        if first is None:
            raise ValueError("no rows to learn from")
        if self.batches > 1:
            data = stored(data.withColumn("part", F.pmod(F.xxhash64("x", "y", F.lit(self.seed)), F.lit(self.batches))), "batches")
        model = MODELS[kind](len(first["x"]))
        w = model.start(self.seed)
        m, v, losses = np.zeros(len(w)), np.zeros(len(w)), []
        for t in range(1, steps + 1):
            part = data if self.batches == 1 else data.where(F.col("part") == (t - 1) % self.batches)
            n, loss, total = _summed(part.select("x", "y"), model, w.copy())
            g = total / max(n, 1)
            losses.append(loss / max(n, 1))
            m, v = self.betas[0] * m + (1 - self.betas[0]) * g, self.betas[1] * v + (1 - self.betas[1]) * g * g
            step = (m / (1 - self.betas[0] ** t)) / (np.sqrt(v / (1 - self.betas[1] ** t)) + self.epsilon)
            w = w - self.rate * (step + self.decay * w)
        if self.batches > 1:
            discard(data)
        return w, losses


def _summed(data: DataFrame, model: LogisticModel | MlpModel, w: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Number of rows, loss and gradient, summed by task and then over all."""

    def gradient(batches):
        total, loss, n = np.zeros(len(w)), 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, model.dim)
            some, g = model.loss(w, x, b.column("y").to_numpy())
            total, loss, n = total + g, loss + some, n + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(w)), -1, -2], pa.int32()), pa.array([*total, loss, n], pa.float64())], names=["k", "v"])

    sums = {r["k"]: r["v"] for r in data.mapInArrow(gradient, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return int(sums.get(-2, 0)), sums.get(-1, 0.0), np.array([sums.get(k, 0.0) for k in range(len(w))])


def project(rows: DataFrame, k: int = 2) -> DataFrame:
    """Principal components of x in k dimensions: a distributed stand-in for a t-SNE plot, and another operator than that."""
    data = rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    out = PCA(k=k, inputCol="features", outputCol="p").fit(data).transform(data).withColumn("p", vector_to_array("p"))
    return out.select(*rows.columns, *(F.col("p")[i].alias(f"p{i}") for i in range(k)))
