"""Signals and saliency maps in long form: (ch, t, v), any length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Samples that one row holds while it is smoothed, besides the margins.
BLOCK = 512
EPSILON = 1e-8


def gaussian_kernel(sigma: float = 10.0, truncate: float = 4.0) -> list[float]:
    """Normalised weights for offsets -radius to radius."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def gaussian_smooth(rows: DataFrame, sigma: float = 10.0, truncate: float = 4.0, by: tuple[str, ...] = ("ch",)) -> DataFrame:
    """Smooths ``v`` along ``t`` (0 to n - 1 in each signal); beyond its ends a signal is its mirror image.

    A sample goes to its block, and near a block's edge to the next one as well; near a signal's ends also at its mirrored
    places. Each block is then one row of bounded size, whatever the signal's length, and is convolved as an array.
    """
    kernel = gaussian_kernel(sigma, truncate)
    radius = len(kernel) // 2
    lengths = rows.groupBy(*by).agg((F.max("t") + 1).cast("long").alias("_n"))
    sized = rows.select(*by, F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v")).join(lengths, list(by))
    turns = F.ceil((F.lit(radius) + F.col("_n")) / (2 * F.col("_n"))).cast("long")
    at_end = (F.col("t") < radius) | (F.col("t") >= F.col("_n") - radius)
    places = F.when(at_end, F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(F.col("t") + 2 * F.col("_n") * k, -F.col("t") - 1 + 2 * F.col("_n") * k)))).otherwise(F.array("t"))
    placed = sized.select(*by, "_n", "v", F.explode(places).alias("_p")).where((F.col("_p") >= -radius) & (F.col("_p") < F.col("_n") + radius))
    low = F.floor((F.col("_p") - radius) / F.lit(BLOCK))
    high = F.floor((F.col("_p") + radius) / F.lit(BLOCK))
    last = F.floor((F.col("_n") - 1) / F.lit(BLOCK))
    dealt = placed.select("*", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, last))).alias("_b"))
    blocks = dealt.groupBy(*by, "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "v"))), lambda s: s["v"]).alias("_w"))
    schema = StructType([*(rows.schema[c] for c in by), StructField("t", LongType()), StructField("v", DoubleType())])
    return blocks.select(*by, "_b", "_w").mapInArrow(lambda b: _convolved(b, np.array(kernel), by), schema)


def _convolved(batches: Iterator[pa.RecordBatch], kernel: np.ndarray, by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Blocks with margins to their samples; the kernel is symmetric."""
    for batch in batches:
        if not batch.num_rows:
            continue
        window = batch.column("_w")
        values, sizes = window.flatten().to_numpy(zero_copy_only=False), window.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        smooth = [np.convolve(values[e - n : e], kernel, mode="valid") for e, n in zip(ends.tolist(), sizes.tolist())]
        lengths = np.array([len(x) for x in smooth])
        row = np.repeat(np.arange(batch.num_rows), lengths)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        t = batch.column("_b").to_numpy()[row] * BLOCK + place
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in by), pa.array(t), pa.array(np.concatenate(smooth))], names=[*by, "t", "v"])


def minmax(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scales ``v`` of each map to 0..1 over all its channels."""
    bounds = rows.groupBy(*by).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    joined = rows.join(bounds, list(by)) if by else rows.crossJoin(F.broadcast(bounds))
    return joined.withColumn("v", (F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low") + EPSILON)).drop("_low", "_high")


def zscore(rows: DataFrame, by: tuple[str, ...] = ("ch",)) -> DataFrame:
    """Each channel less its mean, over its population deviation."""
    moments = rows.groupBy(*by).agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_std"))
    return rows.join(moments, list(by)).withColumn("v", (F.col("v") - F.col("_mean")) / (F.col("_std") + EPSILON)).drop("_mean", "_std")


def channel_importance(rows: DataFrame) -> DataFrame:
    """(ch, t0, t1): mean of each channel at the two time points (column timepoint, 0 or 1)."""
    side = lambda k: F.avg(F.when(F.col("timepoint") == k, F.col("v")))
    return rows.groupBy("ch").agg(side(0).alias("t0"), side(1).alias("t1"))


def channel_ranking(importance: DataFrame, tie: str = "ch") -> DataFrame:
    """Adds total and rank (from 1, largest first; ties by ``tie``). A row per channel, so one task ranks them."""
    total = importance.withColumn("total", F.col("t0") + F.col("t1"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), tie)).cast("long"))


def flip(cams: DataFrame, target: Column) -> DataFrame:
    """cam_0 and cam_1 given back in time order: a target class 1 has passed them swapped."""
    first, second = F.col("first"), F.col("second")
    return cams.select("ch", F.when(target == 1, second).otherwise(first).alias("cam_0"), F.when(target == 1, first).otherwise(second).alias("cam_1"))


def trace_layout(scores: DataFrame, step: float = 6.0, half: float = 2.5) -> DataFrame:
    """Plot rows: each channel's z-scores moved up by its position, with the strip's lower and upper edge."""
    offset = F.col("pos") * F.lit(step)
    return scores.select("ch", "t", (F.col("v") + offset).alias("y"), (offset - half).alias("y_lo"), (offset + half).alias("y_hi"))


def bar_layout(ranking: DataFrame, width: float = 0.35) -> DataFrame:
    """Centres of the two bars of each ranked channel."""
    return ranking.select("ch", (F.col("rank") - 1 - width / 2).alias("x0"), (F.col("rank") - 1 + width / 2).alias("x1"), "t0", "t1")


def patchify(rows: DataFrame, patch: int, by: tuple[str, ...] = ("ch",)) -> DataFrame:
    """Adds patch and pos; a signal whose length is no multiple of ``patch`` is an error."""
    lengths = rows.groupBy(*by).agg((F.max("t") + 1).alias("_n"))
    fits = F.when(F.col("_n") % patch == 0, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("length is no multiple of the patch: "), F.col("_n").cast("string"))).cast("long"))
    return rows.join(lengths, list(by)).withColumn("t", fits).select(*by, F.floor(F.col("t") / patch).cast("long").alias("patch"), (F.col("t") % patch).alias("pos"), "v")


def snippet(signals: DataFrame, start: int, window: int) -> DataFrame:
    """``window`` samples of each channel from ``start`` on; fewer where the signal ends."""
    return signals.withColumn("samples", F.slice("samples", start + 1, window).cast("array<float>"))
