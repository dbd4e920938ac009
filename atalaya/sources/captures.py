"""Captures: landed raw bodies as rows, and the sinks they go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.text import first_group, stable_key
from atalaya.functions.urls import resolve_url

SUCCESS = "SUCCESS"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Files a crawler left, one row per file: ``ruta, fecha_captura, contenido_crudo``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("ruta"),
        F.col("modificationTime").cast("timestamp_ntz").alias("fecha_captura"),
        F.decode("content", "UTF-8").alias("contenido_crudo"),
    )


def ingest_snapshots(bodies: DataFrame) -> DataFrame:
    """Capture rows out of ``fuente_id, fecha_captura, contenido_crudo``."""
    digest = F.sha2("contenido_crudo", 256)
    return bodies.select(
        stable_key(F.col("fuente_id"), F.col("fecha_captura"), digest).alias("id"),
        "fuente_id",
        "fecha_captura",
        "contenido_crudo",
        digest.alias("hash_contenido"),
        F.lit(SUCCESS).alias("estado_ejecucion"),
    )


def append_captures(captures: DataFrame, path: str) -> None:
    """Append, one folder per capture day, so that readers prune by day."""
    (
        captures.withColumn("fecha", F.col("fecha_captura").cast("date"))
        .write.mode("append")
        .partitionBy("fecha")
        .parquet(path)
    )


def bundle(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Join a source's named pages into one text (an edge format).

    A name that landed more than once counts once, the last one, so a bundle
    holds no more pages than the source has sections.
    """
    named = pages.groupBy(*keys, "nombre").agg(
        F.max("pos").alias("pos"), F.max_by("html", "pos").alias("html")
    )
    part = F.concat(
        F.lit(fixed.BUNDLE_OPEN), F.col("nombre"), F.lit("===\n"), F.col("html"),
        F.lit(f"\n{fixed.BUNDLE_CLOSE}\n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("texto"))))
    return named.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda p: p.texto), "").alias("contenido_crudo")
    )


def split_bundle(bundles: DataFrame, body: str = "contenido_crudo") -> DataFrame:
    """One row per page of a bundled text: ``nombre, pos, html``.

    A page ends at its end mark, at the next page mark or with the text. A
    name used twice keeps the last text.
    """
    marked = F.concat(F.lit("\n"), F.col(body))
    parts = F.split(marked, r"\n===PAGE:(?=[^\n]*===(?:\n|$))")
    chunks = F.slice(parts, F.lit(2), F.size(parts))
    pages = F.transform(
        chunks,
        lambda c, i: F.struct(
            F.regexp_extract(c, r"^([^\n]*)===(?:\n|$)", 1).alias("nombre"),
            i.alias("pos"),
            F.regexp_replace(
                F.regexp_replace(c, r"^[^\n]*===(?:\n|$)", ""),
                r"(?s)(^|\n)===ENDPAGE===(\n.*)?$",
                "",
            ).alias("html"),
        ),
    )
    return (
        bundles.withColumn("_pages", pages)
        .withColumn(
            "_pages",
            F.expr("filter(_pages, p -> not exists(_pages, q -> q.nombre = p.nombre and q.pos > p.pos))"),
        )
        .select(*[c for c in bundles.columns if c != body], F.inline("_pages"))
    )


def tokens(page: Column, page_url: Column) -> dict[str, Column]:
    """Nonce and endpoint that a listing page carries for its follow-up calls."""
    endpoint = F.replace(first_group(page, fixed.AJAXURL_TOKEN), F.lit("\\/"), F.lit("/"))
    return {
        "nonce": first_group(page, fixed.NONCE_TOKEN),
        "ajax_url": F.coalesce(
            F.nullif(endpoint, F.lit("")), resolve_url(F.lit(fixed.AJAX_DEFAULT_PATH), page_url)
        ),
    }


def extract_tokens(pages: DataFrame) -> DataFrame:
    """Pages with their tokens; ``reject_reason`` where there is no nonce."""
    found = pages.withColumns(tokens(F.col("html"), F.col("url")))
    return found.withColumn("reject_reason", F.when(F.col("nonce").isNull(), "sin_nonce"))
