"""Streams of captures: incremental ingest, repeats dropped, counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from atalaya.sources.captures import ingest_snapshots

POLL_PERIOD = "12 hours"


def landed_stream(
    spark: SparkSession, folder: str, schema, glob: str = "*.parquet", max_files: int = 1000
) -> DataFrame:
    """New files of a landing folder; a trigger takes a bounded number of them."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that has landed, then stop; a rerun goes on where this ended."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_ingest(bodies: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Capture rows of every new body, appended exactly once."""
    return run_to_parquet(ingest_snapshots(bodies), out, checkpoint)


def repeats_dropped(captures: DataFrame, delay: str = POLL_PERIOD) -> DataFrame:
    """A source's capture with a hash it already had within the delay is dropped.

    The state keeps a key no longer than the delay.
    """
    timed = captures.withColumn("fecha_captura", F.col("fecha_captura").cast("timestamp"))
    unique = timed.withWatermark("fecha_captura", delay).dropDuplicatesWithinWatermark(
        ["fuente_id", "hash_contenido"]
    )
    return unique.withColumn("fecha_captura", F.col("fecha_captura").cast("timestamp_ntz"))


def window_counts(captures: DataFrame, width: str = POLL_PERIOD, late: str = "1 day") -> DataFrame:
    """Captures per source and tumbling window; rows later than ``late`` are left out."""
    timed = captures.withColumn("fecha_captura", F.col("fecha_captura").cast("timestamp"))
    return (
        timed.withWatermark("fecha_captura", late)
        .groupBy(F.window("fecha_captura", width), "fuente_id")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("ventana"), "fuente_id", "n"
        )
    )


def run_updates(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changed counts of each batch in a folder of its own (safe to write again)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/lote={batch_id}")

    return (
        counts.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last value of every window and source."""
    updates = spark.read.parquet(out)
    return updates.groupBy("ventana", "fuente_id").agg(F.max_by("n", "lote").alias("n"))
