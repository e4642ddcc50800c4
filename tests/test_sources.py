import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagpair.sources import arrays, checkpoints, tables
from lagpair.streaming.pairing import paired_stream, visit_counts

PAIRS = [("7", dt.date(2024, 1, 2), dt.date(2024, 3, 4)), ("007", dt.date(2023, 1, 2), dt.date(2023, 12, 31))]


def test_pair_files(spark, tmp_path):
    df = spark.createDataFrame(PAIRS, "id string, before date, after date")
    tables.write_pairs(df, str(tmp_path))
    assert sorted(map(tuple, tables.read_pairs(spark, f"{tmp_path}/longitudinal_pairs").collect())) == sorted(PAIRS)
    tables.write_folds(df.withColumn("fold", F.when(F.col("id") == "7", 1).otherwise(2).cast("long")), f"{tmp_path}/folds")
    back = tables.read_folds(spark, f"{tmp_path}/folds")
    assert sorted(map(tuple, back.collect())) == sorted((*p, 1 if p[0] == "7" else 2) for p in PAIRS)
    assert "PartitionFilters: [isnotnull(fold" in back.where("fold = 1")._jdf.queryExecution().executedPlan().toString()


def test_fold_files(spark, tmp_path):
    head = "ID,Year_Before,Month_Before,Day_Before,Year_After,Month_After,Day_After\n"
    (tmp_path / "longitudinal_pairs_fold_1.csv").write_text(head + "7,2024,01,02,2024,03,04\n")
    (tmp_path / "longitudinal_pairs_fold_12.csv").write_text(head + "007,2023,01,02,2023,12,31\n")
    (tmp_path / "longitudinal_pairs_fold_1.csv.bak").write_text(head + "9,2024,01,02,2024,03,04\n")
    assert sorted(map(tuple, tables.read_fold_files(spark, str(tmp_path)).collect())) == sorted([(*PAIRS[0], 1), (*PAIRS[1], 12)])
    (tmp_path / "longitudinal_pairs_fold_01.csv").write_text(head + "7,2024,01,02,2024,03,04\n")
    with pytest.raises(ValueError):
        tables.read_fold_files(spark, str(tmp_path))


def test_metadata_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("extra,dataset_idx,group_name\nx,5,7_2024_01_02_a\n")
    assert [tuple(r) for r in tables.read_metadata(spark, str(tmp_path / "m.csv")).collect()] == [("7_2024_01_02_a", 5)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_metadata(spark, str(tmp_path / "bad.csv"))
    tables.write_importance(spark.createDataFrame([("b", 1, 0.5, 0.25), ("a", 0, 1.0, 2.0)], "ch string, pos int, t0 double, t1 double"), f"{tmp_path}/imp")
    assert [p.read_text() for p in (tmp_path / "imp").glob("*.csv")] == ["Channel,Mean_Importance_T0,Mean_Importance_T1\na,1.0,2.0\nb,0.5,0.25\n"]
    log = spark.createDataFrame([(1, *[0.5] * 6)], "epoch int, train_loss double, train_acc double, train_auroc double, val_loss double, val_acc double, val_auroc double")
    tables.append_metrics(log, f"{tmp_path}/log")
    tables.append_metrics(log, f"{tmp_path}/log")
    assert tables.read_metrics(spark, f"{tmp_path}/log").count() == 2


def test_npy(spark, tmp_path):
    x = np.arange(10 * 3 * 4, dtype=np.float64).reshape(10, 3, 4)
    np.save(tmp_path / "x.npy", x)
    got = arrays.read_npy(spark, str(tmp_path / "x.npy"), rows=4)
    assert got.rdd.getNumPartitions() == 3
    rows = got.orderBy("dataset_idx").collect()
    assert [r["dataset_idx"] for r in rows] == list(range(10)) and np.allclose([r["embedding"] for r in rows], x.reshape(10, 12)) and rows[0]["n_tokens"] == 3
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    assert arrays.read_npy(spark, str(tmp_path / "none.npy")).count() == 0
    groups = spark.range(10).select(F.col("id").alias("pos"), F.floor(F.col("id") / 4).alias("group"))
    assert arrays.read_paired_npy(spark, str(tmp_path / "x.npy"), str(tmp_path / "x.npy"), groups).where("x0 = x1").count() == 10


def test_written_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k), k / 3]) for k in (5, 0, 3)] + [(None, [1.0, 1.0])], "dataset_idx long, embedding array<double>")
    for path in (f"{tmp_path}/a.npy", f"file://{tmp_path}/b.npy"):
        arrays.write_npy(rows, path)
        got = arrays.read_npy(spark, path, rows=2).orderBy("dataset_idx").collect()
        assert np.allclose([r["embedding"] for r in got], [[0, 0], [3, 1], [5, 5 / 3]])
    assert np.load(tmp_path / "a.npy").dtype == np.float32
    with pytest.raises(ValueError):
        arrays.write_npy(rows.union(spark.createDataFrame([(9, [1.0])], rows.schema)), f"{tmp_path}/c.npy")
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception):
        arrays.read_npy(spark, str(tmp_path / "f.npy")).count()


def test_fold_files_are_named(spark, tmp_path):
    df = spark.createDataFrame([(*p, k) for k, p in enumerate(PAIRS * 2, 1)], "id string, before date, after date, fold long")
    tables.write_fold_files(df, f"{tmp_path}/named")
    assert sorted(p.name for p in (tmp_path / "named").glob("*.csv")) == [f"longitudinal_pairs_fold_{k}.csv" for k in (1, 2, 3, 4)]
    assert sorted(map(tuple, tables.read_fold_files(spark, f"{tmp_path}/named").collect())) == sorted(map(tuple, df.collect()))


def test_recordings_are_cut_where_they_end():
    import pyarrow as pa

    recordings = {"a": {"eeg": np.arange(22 * 50, dtype=np.float64).reshape(22, 50)}, "b": {"eeg": np.zeros((3, 5))}}
    batch = lambda *names: iter([pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["group_name"])])
    read = lambda start, window: [r for out in arrays.snippets(recordings, batch("a"), start, window, arrays.BIPOLAR) for r in out.to_pylist()]
    got = read(10, 20)
    assert [r["channel"] for r in got] == list(arrays.BIPOLAR) and got[1]["samples"] == [float(50 + t) for t in range(10, 30)]
    assert [len(r["samples"]) for r in read(45, 20)] == [5] * 22 and [len(r["samples"]) for r in read(60, 20)] == [0] * 22
    with pytest.raises(ValueError):
        list(arrays.snippets(recordings, batch("b"), 0, 5, arrays.BIPOLAR))
    with pytest.raises(KeyError):
        list(arrays.snippets(recordings, batch("c"), 0, 5, arrays.BIPOLAR))


def test_shared_tables_are_deleted(spark):
    from lagpair.sources import shared

    one, two = shared.stored(spark.range(3), "t"), shared.stored(spark.range(4), "t")
    shared.discard(one)
    assert two.count() == 4
    with pytest.raises(Exception):
        one.count()
    shared.clear(spark)
    with pytest.raises(Exception):
        two.count()


def test_montages(spark):
    assert len(arrays.BIPOLAR) == 22 and len(arrays.UNIPOLAR) == 23
    rows = spark.createDataFrame([(k, 1.0) for k in range(22)], "pos int, v double")
    assert arrays.name_channels(rows, arrays.montage(spark)).where("ch = 'FP1-F7'").first()["pos"] == 0
    with pytest.raises(ValueError):
        arrays.name_channels(rows.where("pos < 3"), arrays.montage(spark))


def test_checkpoints(spark, tmp_path):
    kind = "c map<string, map<string, array<double>>>"
    one = lambda c, f: spark.createDataFrame([(c,)], kind).select(f(F.col("c"))).first()[0]
    full = lambda c: checkpoints.with_head_norm(checkpoints.student_names(checkpoints.parameters(c)))
    assert one({"state_dict": {"a": [0.0]}, "model": {"student.norm.weight": [1.0], "student.norm.bias": [2.0], "other": [3.0]}}, full) == {"norm.weight": [1.0], "norm.bias": [2.0], "other": [3.0], "fc_norm.weight": [1.0], "fc_norm.bias": [2.0]}
    assert one({"": {"norm.weight": [1.0], "fc_norm.weight": [5.0]}}, full) == {"norm.weight": [1.0], "fc_norm.weight": [5.0]}
    path = checkpoints.write_best(spark, str(tmp_path), 54, 0.671, 0.6, {"w": [1.0, 2.0]})
    assert checkpoints.read_weights(spark, path, {"w": [3.0]}) == {"w": [3.0]}
    with pytest.raises(ValueError):
        checkpoints.read_weights(spark, path, {"other": [3.0]})
    assert path.endswith("epoch=54-val_auroc=0.67-val_acc=0.60") and checkpoints.read_weights(spark, path) == {"w": [1.0, 2.0]}


def test_streamed_pairs(spark, tmp_path):
    ts = lambda s: dt.datetime.fromisoformat(s)
    batches = [[("a", ts("2024-01-01T10:00")), ("b", ts("2024-01-05T00:00"))], [("a", ts("2024-01-04T09:00")), ("a", ts("2024-01-04T10:00")), ("b", ts("2024-01-20T00:00"))], [("a", ts("2024-02-01T00:00")), ("b", ts("2024-03-01T00:00"))], [("c", ts("2024-06-01T00:00"))], [("c", ts("2024-06-02T00:00"))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 0:
            stream = spark.readStream.schema("id string, ts timestamp").parquet(f"{tmp_path}/in")
        q = paired_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [("a", dt.date(2024, 1, 1), dt.date(2024, 1, 4), 3), ("a", dt.date(2024, 1, 4), dt.date(2024, 2, 1), 28), ("b", dt.date(2024, 1, 5), dt.date(2024, 1, 20), 15), ("b", dt.date(2024, 1, 20), dt.date(2024, 3, 1), 41)]
    assert visit_counts(spark.read.parquet(f"{tmp_path}/in")).agg(F.sum("n")).first()[0] == 9
