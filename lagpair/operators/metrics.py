"""Classification metrics, exact and distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(pred: str, label: str) -> Column:
    return F.avg((F.col(pred) == F.col(label)).cast("double"))


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, one_class): exact area under the ROC curve, ties counting half; 0 with a flag if a class is missing.

    Rows are first counted by score. Negatives below a score are found within ranges of scores: the sums of 256
    ranges, whose bounds are quantiles, are cumulated, so that no task sorts all the scores.
    """
    by_score = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n")
    )
    bounds = F.broadcast(by_score.agg(F.percentile_approx("s", [k / 256 for k in range(1, 256)], 1000).alias("bounds")))
    ranged = by_score.crossJoin(bounds).select("s", "p", "n", F.size(F.filter("bounds", lambda b: b < F.col("s"))).alias("r"))
    sums = ranged.groupBy("r").agg(F.sum("n").alias("rn"))
    before = Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    lower = sums.select("r", F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(lower), "r")
    area = F.sum(F.col("p") * (F.col("below") + F.col("within") + F.col("n") / 2))
    total = F.sum("p") * F.sum("n")
    return counted.agg(F.coalesce(F.when(total > 0, area / F.nullif(total, F.lit(0))), F.lit(0.0)).alias("auc"), F.coalesce(total == 0, F.lit(True)).alias("one_class"))


def epoch_loss(batch_losses: DataFrame) -> DataFrame:
    """Mean of batch means (columns loss and n), weighted by the batches' sizes."""
    return batch_losses.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def best_epoch(log: DataFrame, metric: str, start_epoch: int = 20) -> DataFrame:
    """The row with the largest metric from ``start_epoch`` on; the earliest of equal ones."""
    return log.where((F.col("epoch") >= start_epoch) & F.col(metric).isNotNull()).orderBy(F.desc(metric), "epoch").limit(1)
