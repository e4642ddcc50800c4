"""CSV sources and sinks of the pair, metadata, metric and importance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagpair import schema
from lagpair.operators.pairs import pair_parts
from lagpair.sources.shared import remove, work_path

# Names of the pair files.
PAIR_FILE = "longitudinal_pairs"
FOLD_FILE = r"longitudinal_pairs_fold_(\d+)\.csv$"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Session names and row numbers; other columns of the file are ignored by name."""
    columns = spark.read.option("header", True).csv(path).columns
    missing = {"group_name", "dataset_idx"} - set(columns)
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))} in {path}")
    text = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.option("header", True).schema(text).csv(path)
    return rows.select("group_name", F.col("dataset_idx").cast("long").alias("dataset_idx"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A folder of all pairs, with the seven columns of the pair file; as many files as there are tasks."""
    pair_parts(pairs).write.option("header", True).csv(f"{path}/{PAIR_FILE}")


def write_folds(folded: DataFrame, path: str) -> None:
    """A folder for each fold, so that a fold is read without the others; every task writes its rows of each fold."""
    pair_parts(folded, "fold").write.partitionBy("fold").option("header", True).csv(path)


def write_fold_files(folded: DataFrame, path: str) -> None:
    """One file ``longitudinal_pairs_fold_<n>.csv`` for each fold, as other programs expect them: a fold is one task's output.
    For folds of any size there is :func:`write_folds`."""
    spark = folded.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = work_path(spark, "fold-files")
    pair_parts(folded, "fold").repartition("fold").write.partitionBy("fold").option("header", True).csv(parts)
    fs.mkdirs(target)
    for folder in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{parts}/fold=*")):
        number = folder.getPath().getName().split("=")[1]
        (file,) = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".csv")]
        name = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PAIR_FILE}_fold_{number}.csv")
        if not fs.rename(file, name):
            raise OSError(f"cannot write {name}")
    remove(spark, parts)


def _typed(rows: DataFrame) -> DataFrame:
    """Pairs (id, before, after) of pair-file columns; ids stay strings."""
    date = lambda s: F.make_date(*(F.col(f"{p}_{s}").cast("int") for p in ("Year", "Month", "Day")))
    more = [c for c in rows.columns if c == "fold"]
    return rows.select(F.col("ID").alias("id"), date("Before").alias("before"), date("After").alias("after"), *more)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.option("header", True).schema(schema.PAIRS).csv(path))


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with their fold, of folders that :func:`write_folds` has written; a filter on the fold prunes folders."""
    return _typed(spark.read.option("header", True).option("basePath", path).schema(schema.PAIRS + ", fold long").csv(path))


def read_fold_files(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with their fold, of files ``longitudinal_pairs_fold_<n>.csv`` in one folder.

    Names are matched whole; two files of one fold are an error.
    """
    rows = spark.read.option("header", True).option("pathGlobFilter", "longitudinal_pairs_fold_*.csv").schema(schema.PAIRS).csv(path)
    named = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.regexp_extract("_metadata.file_name", FOLD_FILE, 1).alias("_fold")).where("_fold <> ''").withColumn("fold", F.col("_fold").cast("long"))
    twice = named.groupBy("fold").agg(F.count_distinct("_path").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several files of fold {twice[0]['fold']}")
    return _typed(named.drop("_path", "_fold"))


def write_importance(importance: DataFrame, path: str) -> None:
    """Channel means in montage order (column pos), three columns."""
    rows = importance.orderBy("pos").select(F.col("ch").alias("Channel"), F.col("t0").alias("Mean_Importance_T0"), F.col("t1").alias("Mean_Importance_T1"))
    rows.coalesce(1).write.option("header", True).csv(path)


def append_metrics(log: DataFrame, path: str) -> None:
    """Appends rows of the metrics log."""
    names = [c.split()[0] for c in schema.METRICS.split(", ")]
    log.select(*names).coalesce(1).write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema.METRICS).csv(path)
