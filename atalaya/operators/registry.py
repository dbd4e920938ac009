"""Extractors by strategy name: built-in ones and the user's own.

An extractor is a function ``(captures, rule) -> items``. A run splits the
captures by strategy, applies each extractor to its part and unions the items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.status import normalize_status
from atalaya.functions.text import compute_once, surrogate_id
from atalaya.functions.urls import resolve_url
from atalaya.operators.extract_feed import extract_feed
from atalaya.operators.extract_html import HtmlRule, extract_cards, extract_featured, extract_html, extract_links, extract_news, unwrap_ajax
from atalaya.operators.extract_json import JsonMapping, explode_items, extract_json, group_merge_regions
from atalaya.operators.extract_rules import JSON, PAGES, with_items
from atalaya.operators.filters import is_excluded_by_rule
from atalaya.operators.mutate import union_items
from atalaya.operators.responses import recover_items, responses_to_items
from atalaya.sources.captures import split_bundle

Extractor = Callable[[DataFrame, object], DataFrame]
DEFAULT = "html_static"
_EXTRACTORS: dict[str, Extractor] = {}


def register(*names: str) -> Callable[[Extractor], Extractor]:
    """Make an extractor known under one or more strategy names."""

    def add(extractor: Extractor) -> Extractor:
        for name in names:
            _EXTRACTORS[name] = extractor
        return extractor

    return add


def extractor_for(name: str | None) -> Extractor:
    """The extractor of a strategy; only a missing name means the default."""
    if (name or DEFAULT) not in _EXTRACTORS:
        raise ValueError(f"unknown strategy: {name}")
    return _EXTRACTORS[name or DEFAULT]


@register("html_static", "browser", "curl_cffi")
def _html(captures: DataFrame, rule: HtmlRule) -> DataFrame:
    return extract_html(captures.withColumnRenamed("contenido_crudo", "html"), rule)


@register("wp_ajax")
def _ajax(captures: DataFrame, rule: HtmlRule) -> DataFrame:
    return extract_html(unwrap_ajax(captures), rule)


@register("json_api")
def _json(captures: DataFrame, mapping: JsonMapping) -> DataFrame:
    items = explode_items(extract_json(captures, mapping))
    return group_merge_regions(items, ["snapshot_id"]) if mapping.agrupar_por else items


@register("rss_feed")
def _feed(captures: DataFrame, rule: object) -> DataFrame:
    return extract_feed(captures)


@register("llm")
def _responses(captures: DataFrame, rule: object) -> DataFrame:
    """Captures whose body is a model's response."""
    return responses_to_items(recover_items(captures, "contenido_crudo"))


@register("subdere_homepage")
def _homepage(captures: DataFrame, rule: object) -> DataFrame:
    """News of a homepage, and its featured programs that the news do not link already."""
    pages = captures.withColumnRenamed("contenido_crudo", "html")
    news = extract_news(pages, F.col("url_base"))
    featured = extract_featured(pages, F.col("url_base"), ["snapshot_id"])
    unseen = featured.join(news.select("snapshot_id", "href"), ["snapshot_id", "href"], "left_anti")
    return union_items(news, unseen).drop("href")


@register("fosis_multipage")
def _sections(captures: DataFrame, rule: object) -> DataFrame:
    """Cards of a bundle's sections, and the links of its last one."""
    pages = split_bundle(captures).withColumnRenamed("pos", "page_ord")
    of_links = F.col("nombre") == fixed.ALLIANCE_PAGE
    cards = extract_cards(pages.where(~of_links), F.col("url_base"), ["snapshot_id"])
    links = extract_links(pages.where(of_links), F.col("url_base"), ["snapshot_id"])
    return union_items(cards, links).drop("page_ord", "nombre")


def source_rules(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Valid rule documents by source id: ``fuente_id, estrategia, regla`` and the URL parts to leave out."""
    named = sources.select(F.col("id").alias("fuente_id"), "nombre")
    return named.join(rules, "nombre").select(
        "fuente_id",
        F.coalesce("estrategia", F.lit(DEFAULT)).alias("estrategia"),
        F.col("config").alias("regla"),
        F.col("excluir_patrones_titulo").alias("_titulos"),
        F.col("excluir_patrones_url").alias("_partes_url"),
    )


def read_by_rules(captures: DataFrame, rules: DataFrame, body: str = "contenido_crudo") -> DataFrame:
    """Captures with ``items`` and a ``reject_reason`` (NULL = read), each by the rule of its own source.

    ``rules`` comes from ``source_rules``, one row per source. The captures are scanned once whatever the number of
    sources and strategies; a source with a bad rule, an unknown strategy or no rule only has its own captures set
    apart. A hot source is an equi join's hot key: AQE broadcasts the rules when their measured size allows it and
    splits the key otherwise.
    """
    ruled = captures.join(rules, "fuente_id", "left")
    return with_items(ruled, F.col(body), F.col("estrategia"), F.col("regla")).drop(body, "regla")


def items_by_rules(read: DataFrame, base_url: str = "url_base", with_rejects: bool = False) -> DataFrame:
    """Item rows of what ``read_by_rules`` has read, without those that a source's exclusion lists name.

    Items of a page count as extracted by their patterns; those of a JSON body are left to normalization. ``grupo``
    is the key under which ``group_merge_regions`` brings items of one body together. ``with_rejects`` also gives the
    captures set apart, as rows with their ``reject_reason`` and without item fields, so that bodies are read once for both.
    """
    kept = [c for c in read.columns if c not in ("items", "reject_reason", "_titulos", "_partes_url")]
    lists = ["_titulos", "_partes_url"]
    rejected = F.col("reject_reason").isNotNull() if with_rejects else F.lit(False)
    if with_rejects:
        kept.append("reject_reason")
        rows = read.select(*kept, *lists, F.inline_outer("items")).where(rejected | F.col("pos").isNotNull())
    else:
        rows = read.where("reject_reason IS NULL").select(*kept, *lists, F.inline("items"))
    of_page = F.col("estrategia") != JSON
    link = F.when(of_page, F.col("_resuelto")).otherwise(F.col("enlace"))
    columns = {c: F.col(c) for c in ("pos", "titulo", "descripcion", "fecha_apertura", "fecha_cierre", "monto", "region", "grupo")}
    resolved = compute_once(rows, _resuelto=F.when(of_page & F.col("enlace").isNotNull(), resolve_url(F.col("enlace"), F.col(base_url))))
    items = resolved.select(
        *kept,
        *lists,
        F.coalesce("identificador", surrogate_id(fixed.LISTING_ID, F.col("titulo"))).alias("identificador"),
        *[c.alias(n) for n, c in columns.items()],
        link.alias("url_detalle"),
        F.when(~rejected, normalize_status(F.col("estado"))).alias("estado"),
        F.when(~rejected, of_page).alias("regex_aplicada"),
    )
    named = is_excluded_by_rule(F.col("titulo"), F.col("url_detalle"), *map(F.col, lists))
    return items.where(rejected | ~(of_page & named)).drop(*lists)


def extract_by_rules(captures: DataFrame, rules: DataFrame, body: str = "contenido_crudo", base_url: str = "url_base") -> DataFrame:
    """Items of all captures that a page or JSON rule reads, in one pass over them."""
    return items_by_rules(read_by_rules(captures, rules, body), base_url)


def extract_all(captures: DataFrame, rules: DataFrame | list[tuple[str, str | None, object]]) -> DataFrame:
    """Items of all captures, feeds and the user's own strategies included.

    With the table of ``source_rules`` the captures are split by strategy, never by source: one pass for pages and
    JSON, one for JSON sources that group their items, one for each further registered strategy, whose extractor gets the captures with their ``regla`` and None.
    A short list of (source id, strategy, rule object) is for rules that are written in code.
    """
    if isinstance(rules, list):
        parts = [extractor_for(how)(captures.where(F.col("fuente_id") == source), rule) for source, how, rule in rules]
        return union_items(*parts)
    built_in = [*PAGES, JSON]
    known = rules.where(F.col("estrategia").isin(built_in))
    grouping = F.get_json_object("regla", "$.json_mapping.agrupar_por").isNotNull() & (F.col("estrategia") == JSON)

    def items_of(some: DataFrame) -> DataFrame:
        read = read_by_rules(captures, some).where("estrategia IS NOT NULL")
        return items_by_rules(read).drop("estrategia")

    keys = [c for c in captures.columns if c != "contenido_crudo"]
    parts = [
        items_of(known.where(~grouping)).drop("grupo"),
        group_merge_regions(items_of(known.where(grouping)), keys).drop("grupo"),
    ]
    for name, extractor in _EXTRACTORS.items():
        if name not in built_in:
            own = rules.where(F.col("estrategia") == name).select("fuente_id", "regla")
            parts.append(extractor(captures.join(own, "fuente_id"), None))
    return union_items(*parts).drop("regla")
