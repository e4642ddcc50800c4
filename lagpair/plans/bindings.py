"""The driver's tables in the roles of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagpair.functions.vectors import linear_head
from lagpair.operators import pairs, sampling, signals
from lagpair.operators.ranking import ranked
from lagpair.sources.shared import stored

SEED = 42
FOLDS = 5
TEST_FOLD = 1
DRAWS = 5
BATCH = 32
TOKEN_DIM = 8
DIMS = 64

#: Head weights and biases by formula, one row a class.
WEIGHTS = [[((c * DIMS + j) * 37 % 101 - 50) / 100 for j in range(DIMS)] for c in range(2)]
BIAS = [0.1, -0.1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session names from orders, with their parts, status and row number."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    return o.select(
        F.concat_ws("_", "o_custkey", F.date_format(d, "yyyy_MM_dd"), "o_orderkey").alias("group_name"),
        F.col("o_custkey").cast("string").alias("id"),
        d.alias("d"),
        "o_orderkey",
        "o_orderstatus",
    )


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.consecutive(pairs.sessions(order_names(spark, sf_dir)), tie="group_name")


def finished_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of order sessions: only finished orders have one, so some dates have none."""
    return order_names(spark, sf_dir).where("o_orderstatus = 'F'").select("id", "d", F.col("o_orderkey").alias("idx"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dataset_idx"), "embedding", "label")


def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, d, idx, tie): each event is an instance; its vector is its id modulo the number of vectors."""
    n = F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n")))
    e = table(spark, sf_dir, "events").crossJoin(n)
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("date").alias("d"), (F.col("event_id") % F.col("n")).alias("idx"), F.col("event_id").alias("tie"))


def event_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: both sides of an example, and the visits themselves, are read from it."""
    return stored(pairs.instances(event_index(spark, sf_dir)), "instances")


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.consecutive(event_index(spark, sf_dir).select("id", "d").distinct())


def event_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = event_instances(spark, sf_dir)
    visits = index.where("k = 0").select("id", "d", "n")
    return sampling.examples(pairs.consecutive(visits, carry=("n",)), index, DRAWS, SEED)


def vector_pairs(spark: SparkSession, sf_dir: str, pool=None) -> DataFrame:
    """Every draw of each pair with its vectors. Where they are pooled, each vector is pooled once, before the join."""
    vectors = embeddings(spark, sf_dir)
    if pool is not None:
        vectors = vectors.withColumn("embedding", pool(F.col("embedding")))
    return sampling.with_vectors(event_examples(spark, sf_dir), vectors)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, z): logits of the fixed linear head on each vector, and its label."""
    e = embeddings(spark, sf_dir)
    return e.select(F.col("dataset_idx").alias("vec_id"), (F.col("label") % 2).cast("long").alias("y"), linear_head(F.col("embedding"), WEIGHTS, BIAS).alias("z"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, t, v, event_id, d): the events' values, one channel for each type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("ch"), "ts", "event_id", F.col("value").alias("v"), F.col("ts").cast("date").alias("d"))
    return ranked(e, ["ts", "event_id"], ("ch",), "t").select("ch", F.col("t").cast("long").alias("t"), "v", "event_id", "d")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal with its time point: 0 for the first half of each channel's samples, 1 for the second."""
    s = signal(spark, sf_dir)
    n = s.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, "ch").select("ch", "t", "v", F.when(2 * F.col("t") < F.col("n"), 0).otherwise(1).alias("timepoint"))


def smoothed_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|v| of each half smoothed on its own, as a saliency map is."""
    rows = halves(spark, sf_dir)
    first = rows.groupBy("ch").agg(F.min(F.when(F.col("timepoint") == 1, F.col("t"))).alias("cut"))
    own = rows.join(first, "ch").select("ch", "timepoint", F.when(F.col("timepoint") == 1, F.col("t") - F.col("cut")).otherwise(F.col("t")).alias("t"), F.abs("v").alias("v"))
    return signals.gaussian_smooth(own, by=("ch", "timepoint"))
