"""Exact dedup as a stateful stream: keyed state on disk, then a check of full bytes on every hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.llm.common import checkpointed, shared_dir, whole_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _arrivals(docs: DataFrame, digest) -> DataFrame:
    text = normalised(whole_text())
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        text.alias("text"),
    )


def stream_classes(
    spark: SparkSession, path: str, schema, work: str, digest=sha256, files_per_batch: int = 10_000
) -> DataFrame:
    """Stream the files of a table through keyed state; return (digest, keep_id, file, size), one row per digest.

    The state is a streaming aggregate in RocksDB under `work`, without watermark or expiry: for each digest the
    stable identifier that stays, the file that holds its content, and the number of rows. Copies meet in partial
    aggregates before the shuffle, so a digest with very many rows is no hot key. A run that is started again with
    the same `work` goes on after the files it has seen; a batch that is repeated overwrites its own folder.
    """
    own = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would each reserve space
    }
    before = {k: spark.conf.get(k, None) for k in own}
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    files = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a table of one file can be streamed too
    # In a struct a null id is the smallest one, so a class of null ids alone still has a locator.
    state = (
        _arrivals(files, digest)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "file")).alias("last"), F.count("*").alias("size"))
        .select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.file").alias("file"), "size")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/classes/batch={number}")

    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        stream = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/state")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kinds = "digest string, keep_id long, file string, size long, batch int"
    latest = F.max_by(F.struct("keep_id", "file", "size"), "batch").alias("last")
    return spark.read.schema(kinds).parquet(f"{work}/classes").groupBy("digest").agg(latest).select("digest", "last.*")


def exact_duplicates(
    spark: SparkSession, path: str, work: str | None = None, digest=sha256, files_per_batch: int = 10_000
) -> DataFrame:
    """Exact copies of a table's texts: doc_id, keep_id, group_size, kept, digest; one row per input row.

    Texts are equal when their bytes are, after lower-casing A-Z; null counts as empty, so null and empty texts are
    copies. The row with the largest doc_id stays. A row whose digest was seen with others is a hit: its bytes are
    compared with those at the retained locator (file and identifier). Rows that differ although their digests
    are equal form classes by their whole text. Rows with a null id lose against any other; where a class
    has null ids alone its keep_id is null and each of its rows is a kept one. Repeated rows of one id and text count in group_size, and each of them is the kept row. An empty table gives no rows.
    """
    table = spark.read.parquet(path)
    work = work or shared_dir(spark, "exact")
    classes = stream_classes(spark, path, table.schema, work, digest, files_per_batch)
    hits = classes.where("size > 1").select(F.col("digest").alias("seen"), "keep_id", F.col("file").alias("at"))
    arrivals = _arrivals(table, digest)
    joined = arrivals.join(checkpointed(hits), F.col("digest") == F.col("seen"), "left")
    hit = F.col("seen").isNotNull()
    joined = checkpointed(
        joined.select(
            "doc_id",
            "digest",
            hit.alias("hit"),
            (hit & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("file") == F.col("at"))).alias("retained"),
            F.when(hit, F.col("text")).alias("text"),
        )
    )
    single = joined.where("not hit").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest"
    )
    again = joined.where("hit")
    retained = checkpointed(
        again.where("retained")
        .groupBy(F.col("digest").alias("kept_digest"))
        .agg(F.max("text").alias("kept_text"))
    )
    compared = again.join(retained, F.col("digest") == F.col("kept_digest")).select(
        "doc_id", "digest", F.when(F.col("text") != F.col("kept_text"), F.col("text")).alias("other_text")
    )
    compared = checkpointed(compared)
    size = F.count("*").alias("group_size")
    counted = compared.groupBy("digest", "other_text").agg(F.max("doc_id").alias("keep_id"), size)
    counted = checkpointed(counted.select(F.col("digest").alias("d"), F.col("other_text").alias("o"), "keep_id", "group_size"))
    several = compared.join(
        counted, (F.col("digest") == F.col("d")) & F.col("other_text").eqNullSafe(F.col("o"))
    ).select("doc_id", "keep_id", "group_size", "digest")
    found = single.unionByName(several)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op3(spark: SparkSession, path: str) -> DataFrame:
    """The contract's columns."""
    found = exact_duplicates(spark, path)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
