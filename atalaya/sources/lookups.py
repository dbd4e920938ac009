"""A layout for point lookups: folders by key hash, rows sorted by key, Parquet bloom filters on the key columns.

A lookup reads the folder of its key only. There, row groups are left out by their least and largest key and, for keys
in between that are absent, by the bloom filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKET = "cubo"


def _bucket(keys: Sequence[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_lookup(
    rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 256, group_bytes: int = 8 << 20, file_rows: int = 5_000_000
) -> None:
    """Write ``rows`` for lookups by all of ``keys``.

    A bucket is one shuffle partition written as files of at most ``file_rows`` rows, so nothing is gathered; choose ``buckets`` so
    that one fits a task (100 TB: tens of thousands). Hashing spreads a hot source over all buckets, since the whole key is hashed.
    """
    if BUCKET in rows.columns:
        raise ValueError(f"the column {BUCKET} names the folders")
    bucket = _bucket([F.col(k) for k in keys], buckets)
    writer = (
        rows.withColumn(BUCKET, bucket)
        .repartition(buckets, BUCKET)
        .sortWithinPartitions(BUCKET, *keys)
        .write.partitionBy(BUCKET)
        .option("maxRecordsPerFile", file_rows)
        .option("parquet.block.size", group_bytes)
    )
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        # a column with a dictionary is filtered by it, and gets no bloom filter
        writer = writer.option(f"parquet.enable.dictionary#{key}", "false")
    writer.parquet(path)


def lookup(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], *wanted: Sequence, buckets: int = 256) -> DataFrame:
    """The rows whose key is one of ``wanted``, a short list of key values; a null matches nothing.

    ``buckets`` is the number it was written with. For lists of many keys, join instead.
    """
    rows = spark.read.schema(StructType([*schema.fields]).add(BUCKET, IntegerType())).parquet(path)
    found = F.lit(False)
    for values in wanted:
        typed = [F.lit(v).cast(schema[k].dataType) for k, v in zip(keys, values, strict=True)]
        same = F.col(BUCKET) == _bucket(typed, buckets)
        for key, value in zip(keys, typed, strict=True):
            same &= F.col(key) == value
        found |= same
    return rows.where(found).drop(BUCKET)
