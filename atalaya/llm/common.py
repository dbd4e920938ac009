"""Helpers shared by the corpus operators: inputs, shared folders, ordered buckets, bounded broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(name: str = "text") -> Column:
    return whole_text(name).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; a local one only where the master is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/atalaya-checkpoints"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a table in the shared folder: like a checkpoint, but compressed."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 4_000_000, column: str = "data") -> Iterator[pa.Table]:
    """Regroup Arrow batches of one task into tables of about `size` bytes of `column`."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(batch.schema.names.index(column)).nbytes
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def joined_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one byte array, and their boundaries (one more than values)."""
    values = column.to_pylist()
    ends = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in values], out=ends[1:])
    return np.frombuffer(b"".join(values), dtype=np.uint8), ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of_8(data: np.ndarray) -> np.ndarray:
    """For each byte position the eight bytes from there as one number (zeros past the end)."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        x[: len(x) - shift] |= x[shift:] << np.uint64(8 * shift)
    return x[: len(data)]


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connected components of numbered nodes inside one task: the smallest node of each component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(label, before):
            return label


def id_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """At most buckets - 1 increasing cut points that deal the rows evenly by an ordered column."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(column, shares, 10 * buckets + 1000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def bounded_broadcast(small: DataFrame, limit: int = 100_000) -> DataFrame:
    """A hint for a side whose rows were counted; beyond the limit Spark joins by shuffle instead."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
