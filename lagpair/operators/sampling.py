"""Training examples: draws of instances, labels, order and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagpair.functions.draws import draw
from lagpair.operators.ranking import ranked

PAIR = ("id", "before", "after")


def day(column: str) -> Column:
    """A date as text, year first."""
    return F.col(column).cast("string")


def pair_hash(side: str, seed: int, epoch: int | None) -> Column:
    """A draw of the pair, the draw number and the side; an epoch makes it anew, without one it is the same in each epoch."""
    parts = [str(seed), side] + ([] if epoch is None else [str(epoch)])
    return draw(*parts, F.col("id"), day("before"), day("after"), F.col("draw").cast("string"))


def expand(pairs: DataFrame, n_draws: int = 5) -> DataFrame:
    """Each pair ``n_draws`` times, numbered from 0."""
    return pairs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_draws - 1).cast("long"))).alias("draw"))


def epoch_length(pairs: DataFrame, n_draws: int = 5) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), (F.count(F.lit(1)) * n_draws).alias("n_examples"))


def labelled(expanded: DataFrame, seed: int = 42, epoch: int | None = None) -> DataFrame:
    """Adds a fair label: 0 in time order, 1 flipped."""
    return expanded.withColumn("label", pair_hash("label", seed, epoch) % 2)


def examples(pairs: DataFrame, index: DataFrame, n_draws: int = 5, seed: int = 42, epoch: int | None = None) -> DataFrame:
    """Each draw of each valid pair: i0 of the before date, i1 of the after date, and the label.

    An instance is drawn by its number on its date. ``index`` has (id, d, idx, k, n) of every instance; only numbers and keys
    are joined, vectors come later. Pairs that bring n_before and n_after, the dates' numbers of instances, are not joined for
    them.
    """
    rows = pairs
    for side in ("before", "after"):
        if f"n_{side}" not in rows.columns:
            rows = rows.join(index.where("k = 0").select("id", F.col("d").alias(side), F.col("n").alias(f"n_{side}")), ["id", side])
    rows = expand(rows.select(*PAIR, "n_before", "n_after"), n_draws)
    for side, name in (("before", "i0"), ("after", "i1")):
        drawn = rows.withColumn("k", pair_hash(name, seed, epoch) % F.col(f"n_{side}"))
        rows = drawn.join(index.select("id", F.col("d").alias(side), "k", F.col("idx").alias(name)), ["id", side, "k"]).drop("k")
    return labelled(rows, seed, epoch).select(*PAIR, "draw", "i0", "i1", "label")


def ordered(drawn: DataFrame) -> DataFrame:
    """idx_1 and idx_2 in the order that the label asks for."""
    flipped = F.col("label") == 1
    return drawn.select(*PAIR, "draw", F.when(flipped, F.col("i1")).otherwise(F.col("i0")).alias("idx_1"), F.when(flipped, F.col("i0")).otherwise(F.col("i1")).alias("idx_2"), "label")


def numbered(pairs: DataFrame) -> DataFrame:
    """Pairs with their place, from 0, in the order of id and dates."""
    return ranked(pairs.select(*PAIR), list(PAIR), name="pair_idx")


def pair_of(global_idx: Column, n_draws: int) -> Column:
    """The pair of an example's place in an epoch."""
    return F.floor(global_idx / F.lit(n_draws)).cast("long")


def batches(drawn: DataFrame, size: int = 32) -> DataFrame:
    """Adds batch_id, from 0, in the order of id, dates and draw; the last batch may be smaller."""
    return ranked(drawn, [*PAIR, "draw"]).withColumn("batch_id", F.floor(F.col("rank") / size).cast("long")).drop("rank")


def with_vectors(drawn: DataFrame, embeddings: DataFrame, first: str = "i0", second: str = "i1") -> DataFrame:
    """Joins the two vectors of each example, last of all, by their row numbers."""
    for idx, name in ((first, "x0"), (second, "x1")):
        drawn = drawn.join(embeddings.select(F.col("dataset_idx").alias(idx), F.col("embedding").alias(name)), idx)
    return drawn


def all_instance_pairs(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Every before instance with every after instance of each pair: (id, before, after, idx_before, idx_after)."""
    before = index.select("id", F.col("d").alias("before"), F.col("idx").alias("idx_before"))
    after = index.select("id", F.col("d").alias("after"), F.col("idx").alias("idx_after"))
    return pairs.select(*PAIR).join(before, ["id", "before"]).join(after, ["id", "after"]).select(*PAIR, "idx_before", "idx_after")


def epoch_order(rows: DataFrame, key: list[str], seed: int, epoch: int) -> DataFrame:
    """Rows in an order that seed and epoch fix: a range-partitioned sort by a draw."""
    return rows.orderBy(draw(str(seed), str(epoch), *(F.col(k).cast("string") for k in key)), *key)


def epoch_ranks(rows: DataFrame, key: list[str], seed: int, epoch: int) -> DataFrame:
    """Rows with their place, from 0, in the order of :func:`epoch_order`."""
    keyed = rows.withColumn("_draw", draw(str(seed), str(epoch), *(F.col(k).cast("string") for k in key)))
    return ranked(keyed, ["_draw", *key], name="place").drop("_draw")


def train_test_batches(folded: DataFrame, index: DataFrame, test_fold: int, n_draws: int = 5, size: int = 32, seed: int = 42, epoch: int = 0) -> tuple[DataFrame, DataFrame]:
    """The loader as one call: (training examples, test examples), each with batch_id. ``folded`` has pairs with their fold,
    ``index`` instances. Training examples are drawn and shuffled anew for every epoch; the test fold's are not. It is an error
    if the test fold, or every other one, has no pair."""
    from lagpair.operators.folds import split

    train, test = split(folded, test_fold)
    shuffled = epoch_ranks(examples(train, index, n_draws, seed, epoch), [*PAIR, "draw"], seed, epoch)
    return shuffled.withColumn("batch_id", F.floor(F.col("place") / size).cast("long")).drop("place"), batches(examples(test, index, n_draws, seed), size)


def group_ids(positions: DataFrame, size: int = 4, position: str = "pos") -> DataFrame:
    """The constructed group of a row, ``size`` rows each."""
    return positions.withColumn("group", F.floor(F.col(position) / size).cast("long"))


def repeat_ids(groups: DataFrame, times: int = 16) -> DataFrame:
    """Each group id as often as its instance pairs."""
    return groups.select(F.explode(F.array_repeat("group", times)).alias("group"))
