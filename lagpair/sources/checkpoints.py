"""Checkpoints as maps of parameter names to numbers, and model weights as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entries that may hold the parameters, in the order in which they are tried, and the prefix to strip.
HOLDERS = ("model|module", "model", "state_dict")
STUDENT = "student."
OLD_NORM, NEW_NORM = "norm.", "fc_norm."


def parameters(checkpoint: Column) -> Column:
    """The parameters (name to array) of a map of maps: the first holder that is present, else the entry with an empty name."""
    return F.coalesce(*[F.try_element_at(checkpoint, F.lit(h)) for h in HOLDERS], F.try_element_at(checkpoint, F.lit("")))


def student_names(params: Column) -> Column:
    """Parameter names without the student's prefix; a name without it stays."""
    bare = lambda k, _: F.when(F.startswith(k, F.lit(STUDENT)), F.substring(k, F.lit(len(STUDENT) + 1), F.length(k))).otherwise(k)
    return F.transform_keys(params, bare)


def with_head_norm(params: Column) -> Column:
    """Copies the norm's weight and bias to the head's norm if it has none of its own."""
    old = F.map_filter(params, lambda k, _: k.isin(f"{OLD_NORM}weight", f"{OLD_NORM}bias"))
    needed = F.map_contains_key(params, F.lit(f"{OLD_NORM}weight")) & ~F.map_contains_key(params, F.lit(f"{NEW_NORM}weight"))
    renamed = F.transform_keys(old, lambda k, _: F.concat(F.lit(NEW_NORM), F.substring(k, F.lit(len(OLD_NORM) + 1), F.length(k))))
    return F.when(needed, F.map_concat(params, renamed)).otherwise(params)


def write_best(spark: SparkSession, folder: str, epoch: int, auroc: float, acc: float, weights: dict[str, list[float]]) -> str:
    """Weights of the selected epoch, under a name that tells epoch and metrics."""
    path = f"{folder}/epoch={epoch:02d}-val_auroc={auroc:.2f}-val_acc={acc:.2f}"
    spark.createDataFrame(list(weights.items()), "name string, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def read_weights(spark: SparkSession, path: str, overrides: dict[str, list[float]] | None = None) -> dict[str, list[float]]:
    """A model's weights by name; those of ``overrides`` take the place of the stored ones, which must have their names."""
    stored = {r["name"]: list(r["v"]) for r in spark.read.parquet(path).collect()}
    unknown = set(overrides or {}) - set(stored)
    if unknown:
        raise ValueError(f"no weight {', '.join(sorted(unknown))} in {path}")
    return {**stored, **(overrides or {})}


def as_map(weights: DataFrame) -> DataFrame:
    """One row with all weights as a map."""
    return weights.agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("params"))
