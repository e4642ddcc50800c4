"""Array sources: ``.npy`` files as a Spark data source, HDF5 where h5py is at hand, montages and signal slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a ``.npy`` file that one partition reads, and that one batch holds.
ROWS = 4096
BATCH = 256

# The channels of the two montages, in order.
BIPOLAR = (
    "FP1-F7", "F7-T3", "T3-T5", "T5-O1", "FP2-F8", "F8-T4", "T4-T6", "T6-O2", "T3-C3", "C3-CZ", "CZ-C4",
    "C4-T4", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FP2-F4", "F4-C4", "C4-P4", "P4-O2", "A1-T3", "T4-A2",
)
UNIPOLAR = ("FP1", "FP2", "F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "F7", "F8", "T3", "T4", "T5", "T6", "A1", "A2", "FZ", "CZ", "PZ", "T1", "T2")


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _opened(path: str) -> pa.NativeFile:
    store, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return store.open_input_file(place)


def npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and first byte of the numbers of an array file in any store that Arrow reads."""
    with _opened(path) as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if by_column and len(shape) > 1:
            raise ValueError(f"{path} is stored column by column")
        return shape, kind, f.tell()


def write_npy(vectors: DataFrame, path: str) -> None:
    """Writes embeddings, ordered by dataset_idx, as an array file of float32. They pass the driver a partition at a time."""
    rows = vectors.where("dataset_idx is not null").orderBy("dataset_idx").select(F.col("embedding").cast("array<float>").alias("embedding"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if sizes["low"] != sizes["high"]:
        raise ValueError("vectors are not of one length")
    store, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(place) as out:
        np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (sizes["n"], sizes["high"] or 0)})
        for row in rows.toLocalIterator():
            out.write(np.array(row["embedding"], dtype="<f4").tobytes())


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        n = npy_header(self.path)[0][0]
        return [_Rows(s, min(s + self.rows, n)) for s in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        shape, kind, first = npy_header(self.path)
        size = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
        file = _opened(self.path)
        for s in range(partition.start, partition.end, BATCH):
            n = min(s + BATCH, partition.end) - s
            part = np.frombuffer(file.read_at(n * size, first + s * size), kind).reshape(n, *shape[1:]).astype(np.float32)
            flat = part.reshape(len(part), -1)
            values = pa.array(flat.ravel(), pa.float32())
            offsets = pa.array(np.arange(len(part) + 1) * flat.shape[1], pa.int32())
            tokens = part.shape[1] if part.ndim == 3 else 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(part))), pa.ListArray.from_arrays(offsets, values), pa.array([tokens] * len(part), pa.int32())], names=["dataset_idx", "embedding", "n_tokens"])


class NpySource(DataSource):
    """Rows of an array file: dataset_idx, the row flattened token by token, and its number of tokens.

    Each partition reads its own range of rows. The path is local, or a URI of a store that Arrow reads.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "dataset_idx long, embedding array<float>, n_tokens int"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).option("rows", rows).load()


def read_paired_npy(spark: SparkSession, before: str, after: str, groups: DataFrame) -> DataFrame:
    """Rows of two parallel arrays with their group: (pos, group, x0, x1). ``groups`` has (pos, group)."""
    x0 = read_npy(spark, before).select(F.col("dataset_idx").alias("pos"), F.col("embedding").alias("x0"))
    x1 = read_npy(spark, after).select(F.col("dataset_idx").alias("pos"), F.col("embedding").alias("x1"))
    return x0.join(x1, "pos").join(groups, "pos")


def snippets(recordings, batches: Iterator[pa.RecordBatch], start: int, window: int, channels: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of the named recordings' channels, ``window`` samples from ``start`` on; fewer, or none, where a recording ends.

    ``recordings`` gives an array of (channels, time) as ``recordings[name]["eeg"]``. A name that it does not have is an error.
    """
    for batch in batches:
        for name in batch.column("group_name").to_pylist():
            part = np.asarray(recordings[name]["eeg"][:, start : start + window]).astype(np.float32)
            if len(part) != len(channels):
                raise ValueError(f"{name} has {len(part)} channels, the montage {len(channels)}")
            samples = pa.array(list(part), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(len(part)), pa.int32()), pa.array(channels), samples], names=["group_name", "pos", "channel", "samples"])


def read_hdf5(spark: SparkSession, path: str, groups: DataFrame, start: int, window: int, montage: tuple[str, ...] = BIPOLAR) -> DataFrame:
    """A slice of each named recording, one row a channel. Needs h5py on the executors."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py; convert recordings to Parquet signals instead") from e

    def read(batches):
        import h5py

        with h5py.File(path, "r") as f:
            yield from snippets(f, batches, start, window, montage)

    return groups.select("group_name").distinct().mapInArrow(read, "group_name string, pos int, channel string, samples array<float>")


def montage(spark: SparkSession, channels: tuple[str, ...] = BIPOLAR) -> DataFrame:
    """(pos, ch) of a montage."""
    return spark.createDataFrame(list(enumerate(channels)), "pos int, ch string")


def name_channels(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds the channel names to rows with pos. It is an error if the montage has another number of channels."""
    known, given = channels.count(), rows.agg(F.count_distinct("pos")).first()[0]
    if known != given:
        raise ValueError(f"the montage has {known} channels, the rows {given}")
    return rows.join(F.broadcast(channels), "pos")


def long_signal(signals: DataFrame) -> DataFrame:
    """(group_name, ch, t, v) of rows with an array of samples."""
    return signals.select("group_name", F.col("channel").alias("ch"), F.posexplode("samples").alias("t", "v")).withColumns({"t": F.col("t").cast("long"), "v": F.col("v").cast("double")})
