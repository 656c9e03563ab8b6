"""Helpers shared by the training-data operators: reading, scratch tables, Arrow blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents holds, but for a single longer document.
BLOCK_BYTES = 6 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_column(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quantwell-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder; each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one scan of one column."""
    return int(df.agg(F.sum(F.octet_length(F.col(column).cast("string"))).alias("b")).first()["b"] or 0)


def parts_for(spark: SparkSession, size: float, each: float, least: int = 1) -> int:
    """How many partitions hold `size` at `each` apiece."""
    return max(least, int(-(-size // each)))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, end to end, and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], target: int = BLOCK_BYTES, column: int = 1) -> Iterator[pa.Table]:
    """Regroups Arrow batches into tables of about `target` bytes of text, in the order read."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = as_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            room = target - size
            stop = int(np.searchsorted(offsets, offsets[start] + room, "right")) - 1
            stop = min(max(stop, start + (not held)), batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(offsets[stop] - offsets[start])
                start = stop
            if start < batch.num_rows or size >= target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def slices(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of pieces of one array, by item offsets, without a copy for each."""
    step = data.itemsize
    if len(offsets) and int(offsets[-1]) * step >= 1 << 31:
        raise ValueError("pieces of one block hold 2 GiB or more")
    return pa.BinaryArray.from_buffers(
        pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets * step, np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: an invertible map that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + counts[i] - 1 of all i, end to end."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
