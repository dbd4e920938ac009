"""Writing tables back: versions for tables that change, appends for logs.

Plain parquet has no row updates, so a changed table is written as a new
version beside the old one and becomes current once its write is complete.
The path being read is never overwritten, and a lost job leaves the old
version current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish_version(df: DataFrame, root: str, version: int, buckets: list[str] | None = None) -> None:
    """Write one version; rerunning a failed write of the same version is safe."""
    out = df.write.mode("overwrite")
    if buckets:
        out = out.partitionBy(*buckets)
    out.parquet(f"{root}/version={version:012d}")


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version:012d}")


def append_log(df: DataFrame, path: str, day_of: str | None = None) -> None:
    """Append to a log table, by day when a time column is named."""
    if day_of:
        df = df.withColumn("fecha", F.col(day_of).cast("date"))
        df.write.mode("append").partitionBy("fecha").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def write_report(lines: DataFrame, path: str, header: list[str]) -> None:
    """Ordered text: header lines first, then one line per source.

    The part files in name order are the report; nothing goes through one task.
    """
    spark = lines.sparkSession
    head = spark.createDataFrame([(i, "", h) for i, h in enumerate(header)], "n int, fuente string, linea string")
    body = lines.select(F.lit(len(header)).alias("n"), "fuente", "linea")
    (
        head.unionByName(body)
        .orderBy("n", "fuente")
        .select("linea")
        .write.mode("overwrite")
        .text(path)
    )
