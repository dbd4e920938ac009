"""Keep one row, or a bounded number of rows, per group.

All of them rank with ``row_number() <= k``: Spark then limits each group
before the shuffle (a map task sends at most k rows of a group), so a hot
group never lands in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in input order."""
    return cap_per_group(df, keys, [F.asc(c) for c in order], 1)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in input order."""
    return cap_per_group(df, keys, [F.desc(c) for c in order], 1)


def latest_snapshot(captures: DataFrame) -> DataFrame:
    return dedupe_last(captures, ["fuente_id"], ["fecha_captura", "id"])


def content_changed(captures: DataFrame, bucket: str = "hour") -> DataFrame:
    """Captures with a flag: does the hash differ from the source's previous one?

    A source may own a large part of all captures, so rows are compared inside
    (source, time bucket) groups. Only the first row of a bucket needs the
    last hash of the source's previous bucket, which comes from a table with
    one row per bucket.
    """
    start = F.date_trunc(bucket, F.col("fecha_captura")).cast("timestamp_ntz")
    rows = captures.withColumn("_bucket", start)
    last = rows.groupBy("fuente_id", "_bucket").agg(
        F.max_by("hash_contenido", F.struct("fecha_captura", "id")).alias("_last")
    )
    before = Window.partitionBy("fuente_id").orderBy("_bucket")
    carry = last.select(
        "fuente_id", "_bucket", F.lag("_last").over(before).alias("_carried")
    )
    within = Window.partitionBy("fuente_id", "_bucket").orderBy("fecha_captura", "id")
    previous = F.coalesce(F.lag("hash_contenido").over(within), F.col("_carried"))
    return (
        rows.join(carry, ["fuente_id", "_bucket"])
        .withColumn("hash_anterior", previous)
        .withColumn("cambio", ~F.col("hash_contenido").eqNullSafe(F.col("hash_anterior")))
        .drop("_bucket", "_carried")
    )
