"""Subject-disjoint folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagpair.operators.ranking import ranked, tile


def shuffled_ids(rows: DataFrame, seed: int) -> DataFrame:
    """Distinct ids with their rank in an order that the seed fixes, and their number."""
    ids = rows.select("id").where("id is not null").distinct().withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), "id")))
    return ranked(ids, ["_key", "id"], size="total").select("id", "rank", "total")


def fold_map(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, fold): folds from 1 to k, sizes at most one apart, the larger ones first."""
    if k < 1:
        raise ValueError("there is at least one fold")
    return shuffled_ids(rows, seed).select("id", tile(F.col("rank"), F.col("total"), k).alias("fold"))


def exact_fold_map(rows: DataFrame, k: int, seed: int = 42, most: int = 1_000_000) -> DataFrame:
    """Folds of the legacy seeded shuffle of the sorted ids. The ids go through the driver, so there may be ``most`` at most."""
    import numpy as np

    ids = [r["id"] for r in rows.select("id").where("id is not null").distinct().orderBy("id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} ids: use fold_map")
    order = np.array(ids, dtype=object)
    np.random.RandomState(seed).shuffle(order)
    parts = np.array_split(order, k)
    return rows.sparkSession.createDataFrame([(i, n) for n, part in enumerate(parts, 1) for i in part], "id string, fold long")


def assign(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Pairs with their subject's fold. Spark broadcasts the map while it is small; it grows with the subjects."""
    return pairs.join(folds, "id")


def split(folded: DataFrame, test_fold: int) -> tuple[DataFrame, DataFrame]:
    """(training pairs, test pairs). It is an error if the test fold, or every other one, has no pair."""
    train, test = folded.where(F.col("fold") != test_fold), folded.where(F.col("fold") == test_fold)
    if test.isEmpty():
        raise ValueError(f"no fold {test_fold}")
    if train.isEmpty():
        raise ValueError("no training fold")
    return train, test


def split_name(test_fold: int) -> Column:
    return F.when(F.col("fold") == test_fold, "test").otherwise("train")


def union_folds(folded: DataFrame, folds: list[int]) -> DataFrame:
    """The pairs of several folds, as the union of each one's, by column name."""
    out = None
    for f in folds:
        part = folded.where(F.col("fold") == f)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no training fold")
    return out


def fold_sizes(folded: DataFrame, k: int) -> DataFrame:
    """(test_fold, n_train, n_test) for each turn of a k-fold rotation."""
    counts = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    turns = folded.sparkSession.range(1, k + 1).select(F.col("id").alias("test_fold"))
    total = folded.agg(F.count(F.lit(1)).alias("total"))
    return turns.join(counts, F.col("test_fold") == F.col("fold"), "left").crossJoin(F.broadcast(total)).select("test_fold", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n_train"), F.coalesce("n", F.lit(0)).alias("n_test"))


def group_shuffle_split(rows: DataFrame, train_share: float = 0.6, seed: int = 42) -> DataFrame:
    """(id, split): the first floor(share * ids) ids of the shuffled order are train."""
    return shuffled_ids(rows, seed).select("id", F.when(F.col("rank") < F.floor(F.col("total") * train_share), "train").otherwise("test").alias("split"))
