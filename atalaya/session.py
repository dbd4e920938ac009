"""Session settings the jobs are designed for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole pages go to Python: fewer of them at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
}


def build_session(app: str = "atalaya", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def several_states(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside may keep several kinds of state per key, whatever the session was built with.

    Spark's default store holds one kind only; another store that the session names is left as it is. A stream takes
    its settings when it starts and keeps them in its checkpoint, so the session has its own again afterwards.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    given = spark.conf.get(name)
    if given.endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, given)


@contextmanager
def small_splits(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What is planned inside reads files in splits of at most ``size``, whatever the session was built with.

    A large table is then dealt over the cores by its own row groups, so it need not be shuffled for that, and sorts
    inside a task stay small. A plan takes its splits when it runs, so write inside.
    """
    name = "spark.sql.files.maxPartitionBytes"
    given = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, given)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach, for streams and written tables.

    The cluster names its shared storage in ``spark.checkpoint.dir``; only
    a local master may do without it and gets a folder of its own machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="atalaya-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def working_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A ``shared_folder`` for tables that are read back inside only; it is deleted at the end, after a failure too."""
    folder = shared_folder(spark, name)
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
