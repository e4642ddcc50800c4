"""Connected components by alternating large and small stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagpair.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a and b, long) but the roots; a root is its component's least node.

    Each star joins the edges with the least neighbour of each node, both sides
    being stored tables, so that adaptive execution can split the rows of a node
    with very many edges. The number of rounds grows with the logarithm of the
    longest path.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state_before = now, state
        now, state = after, _state(after)
        discard(before, least, large, small)
        if state == state_before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
