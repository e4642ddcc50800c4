"""Row numbers without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagpair.sources.shared import stored


def ranked(df: DataFrame, order: list[str], by: tuple[str, ...] = (), name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the rank, from 0, of each row in ``order`` within the columns ``by`` (within the whole table if there are none), and
    as ``size`` the number of rows of its group.

    Rows are dealt by ranges of ``by`` and ``order`` whose bounds Spark samples, sorted and written with their place. A group
    of any size is spread over as many tasks as its rows need; what is gathered by group is a row for each task that has some
    of it.
    """
    keys = [*by, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(placed, "ranked").withColumn("_task", F.shiftright("_at", 33).cast("int"))
    parts = rows.groupBy(*by, "_task").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*(by or (F.lit(0),)))
    before = group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("_low") - F.coalesce(F.sum("_n").over(before), F.lit(0))
    firsts = parts.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_task").alias("_k__task"), shift.alias("_shift"), F.sum("_n").over(group).alias("_size"))
    match = [rows[k].eqNullSafe(firsts[f"_k_{k}"]) for k in by] + [rows["_task"] == firsts["_k__task"]]
    out = rows.join(firsts if by else F.broadcast(firsts), match)  # without groups there is a row for each task
    return out.select(*df.columns, (F.col("_at") - F.col("_shift")).alias(name), *([F.col("_size").alias(size)] if size else []))


def tile(rank: Column, total: Column, tiles: int) -> Column:
    """Near-equal tile (from 1) of a rank (from 0): the first ``total`` modulo ``tiles`` tiles have one row more."""
    small = F.floor(total / F.lit(tiles)).cast("long")
    larger = total - small * tiles
    edge = larger * (small + 1)
    return F.when(rank < edge, F.floor(rank / (small + 1)) + 1).otherwise(F.floor((rank - edge) / F.greatest(small, F.lit(1))) + larger + 1).cast("long")
