"""Consolidation of landed result pages, by the rule that ends a page series.

Each rule first reduces a slim table (run, page, size) to one row per run
with the last page that counts, combined before the shuffle, and then keeps
the pages up to it. Bodies are never gathered by run; the per-run row is
small, so AQE broadcasts it when it can and splits a hot run otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.urls import set_query_param

RUN = ["fuente_id", "run_id"]


def _keep_until(pages: DataFrame, limits: DataFrame) -> DataFrame:
    return (
        pages.join(limits, RUN)
        .where(F.col("page") <= F.col("_last_page"))
        .drop("_last_page")
    )


def _last_page(stop: Column, max_pages: int | None) -> Column:
    """Where a series ends; all landed pages count unless a rule or a given limit ends it."""
    last = F.coalesce(stop, F.max("page"))
    return (last if max_pages is None else F.least(last, F.lit(max_pages))).alias("_last_page")


def page_size(body: Column, root: str = "$") -> Column:
    """Number of items of a JSON page; NULL where the root is not a list."""
    listed = body if root == "$" else F.get_json_object(body, root)
    return F.json_array_length(listed)


def consolidate_pages_short(
    pages: DataFrame, size: int, max_pages: int | None = None
) -> DataFrame:
    """Pages up to the first one with fewer than ``size`` items, that included.

    ``n_items`` is NULL for a page that is not a list: it ends the series and
    is not part of it.
    """
    short = F.col("n_items") < size
    broken = F.col("n_items").isNull()
    stop = F.least(
        F.min(F.when(short, F.col("page"))),
        F.min(F.when(broken, F.col("page") - 1)),
    )
    limits = pages.groupBy(*RUN).agg(_last_page(stop, max_pages))
    return _keep_until(pages, limits)


def consolidate_pages_total(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages up to the total that the first page declares (none declared: one).

    An empty page ends the series: the page after it was never asked for.
    """
    declared = F.coalesce(F.max(F.when(F.col("page") == 1, F.col("total_pages"))), F.lit(1))
    first_empty = F.min(F.when(F.col("n_items") == 0, F.col("page")))
    limits = pages.groupBy(*RUN).agg(
        _last_page(F.least(F.greatest(declared, F.lit(1)), first_empty), max_pages)
    )
    return _keep_until(pages, limits)


def consolidate_pages_found(
    pages: DataFrame,
    max_pages: int | None = None,
    page_size: int = fixed.FOUND_PAGE_SIZE,
) -> DataFrame:
    """Pages before the first empty html, up to the count the first page found."""
    found = F.max(F.when(F.col("page") == 1, F.col("found")))
    enough = F.when(found > 0, F.ceil(found / page_size))
    empty = F.coalesce(F.col("html"), F.lit("")) == ""
    limits = pages.groupBy(*RUN).agg(
        _last_page(F.least(enough, F.min(F.when(empty, F.col("page"))) - 1), max_pages)
    )
    return _keep_until(pages, limits)


def merge_found_pages(kept: DataFrame) -> DataFrame:
    """One capture per run from the kept pages.

    Of a page that landed more than once the latest copy counts (by
    ``fecha_captura``; without that column, or at equal times, the first body
    in text order).
    """
    html = F.min("html")
    if "fecha_captura" in kept.columns:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        age = F.timestamp_diff("MICROSECOND", F.col("fecha_captura").cast("timestamp_ntz"), epoch)
        html = F.min(F.struct(F.coalesce(age, F.lit(2**62)).alias("age"), "html"))["html"]
    once = kept.groupBy(*RUN, "page").agg(html.alias("html"), F.max("found").alias("found"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "html")))
    merged = once.groupBy(*RUN).agg(
        F.array_join(F.transform(ordered, lambda p: p.html), "\n").alias("html"),
        F.max(F.when(F.col("page") == 1, F.col("found"))).alias("total_found"),
        F.max("page").alias("pages_fetched"),
    )
    return merged.withColumn("hash_contenido", F.sha2("html", 256))


def page_urls(sources: DataFrame, param: str = "page") -> DataFrame:
    """The URL of every page of a source's list, from its page count."""
    return sources.withColumn("page", F.explode(F.sequence(F.lit(1), F.col("paginas")))).withColumn(
        "page_url", set_query_param(F.col("url"), param, F.col("page"))
    )
