"""Items out of HTML captures, by selectors that each source declares."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atalaya import fixed_values as fixed
from atalaya.functions.dom import readable
from atalaya.functions.status import normalize_status
from atalaya.functions.text import (
    any_of,
    blank_to_null,
    compute_once,
    last_segment,
    squeeze_blank,
    strict_json,
    strip,
    surrogate_id,
)
from atalaya.functions.urls import resolve_url
from atalaya.operators.dedupe import dedupe_first
from atalaya.operators.extract_rules import RulePage, compiled, rule_document, with_items

@dataclass(frozen=True)
class HtmlRule:
    """Selectors and text patterns of one source's list page."""

    contenedor_items: str
    identificador: str
    titulo: str
    descripcion: str | None = None
    link_detalle: str | None = None
    estado: str | None = None
    fecha_cierre: str | None = None
    monto: str | None = None
    region: str | None = None
    patrones: dict[str, str] = field(default_factory=dict)


def item_columns(base_url: str = "url_base") -> list[Column]:
    """What an item read by a rule comes out as; a missing id is made of the title."""
    href = F.col("enlace")
    return [
        F.col("pos"),
        F.coalesce("identificador", surrogate_id(fixed.LISTING_ID, F.col("titulo"))).alias("identificador"),
        F.col("titulo"),
        F.col("descripcion"),
        F.when(href.isNotNull(), resolve_url(href, F.col(base_url))).alias("url_detalle"),
        normalize_status(F.col("estado")).alias("estado"),
        F.col("fecha_cierre"),
        F.col("monto"),
        F.col("region"),
    ]


def extract_html(pages: DataFrame, rule: HtmlRule, base_url: str = "url_base") -> DataFrame:
    """One row per list item; rows without an id or a title are left out.

    ``pages`` has ``html`` and the base URL; its other columns are kept. A
    date or amount that no selector found is looked up in the item's whole
    text when the source has a pattern for it. Patterns are applied here and
    marked as applied, so that normalization does not apply them again. A rule
    with a selector or pattern that cannot be read raises here, before any job.
    """
    document = rule_document(rule)
    if isinstance(fault := compiled("html_static", document), str):
        raise ValueError(f"{fault}: {rule}")
    kept = [c for c in pages.columns if c != "html"]
    read = with_items(pages, F.col("html"), F.lit("html_static"), F.lit(document))
    items = read.select(*kept, F.inline("items"))
    return items.select(*kept, *item_columns(base_url), F.lit(True).alias("regex_aplicada"))


def unwrap_ajax(captures: DataFrame, body: str = "contenido_crudo") -> DataFrame:
    """``html`` of a JSON wrapper, or the body itself where it is not one."""
    inner = F.try_variant_get(strict_json(F.col(body)), "$.html", "string")
    return captures.withColumn("html", F.coalesce(inner, F.col(body))).drop(body)


# --- links and cards ------------------------------------------------------------
def _page_column(read: Callable[[str], list[dict]], **fields: pa.DataType) -> Callable[[Column], Column]:
    """A function of pages that gives what ``read`` finds in each, by position, so that no nodes leave the reader."""
    kinds = {pa.int32(): T.IntegerType(), pa.string(): T.StringType()}
    found = {"pos": pa.int32(), **fields}
    arrow = pa.list_(pa.struct(list(found.items())))

    def batch(pages: pa.Array) -> pa.Array:
        return pa.array([read(html or "") for html in pages.to_pylist()], arrow)

    batch.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, T.ArrayType(T.StructType([T.StructField(n, kinds[k]) for n, k in found.items()])))


def _links_of(html: str) -> list[dict]:
    page = RulePage(html)
    return [{"pos": n, "href": page.named[at]["href"], "texto": page.text_of(at)} for n, at in enumerate(page.all("a[href]"))]


_links = _page_column(_links_of, href=pa.string(), texto=pa.string())


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of every page: ``pos, href, texto``."""
    kept = [c for c in pages.columns if c != "html"]
    rows = compute_once(pages, _leido=_links(F.col("html"))).select(*kept, F.inline("_leido"))
    return rows.select(*kept, "pos", "href", blank_to_null(F.col("texto")).alias("texto")).where("href <> ''")


def base_of(base_url: str | Column) -> Column:
    return F.lit(base_url) if isinstance(base_url, str) else base_url


def first_per_url(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per URL within a capture, by a bounded rank (skew-safe)."""
    return dedupe_first(items, [*keys, "url_detalle"], order)


def _cards_of(html: str) -> list[dict]:
    """A page's cards with title, first text and the link of their first button; those without title or link are left out."""
    page = RulePage(html)
    found = []
    buttons = [at for at in page.all("a") if "btn" in re.split("[ \t\n\r\f]", page.named[at].get("class", ""))]
    for n, box in enumerate(page.all("div[style*='background-color']")):
        title, text = page.first("h2", box), page.first("p", box)
        i = bisect_right(buttons, box)
        link = buttons[i] if i < len(buttons) and buttons[i] <= page.last[box] else None
        href = None if link is None else page.named[link].get("href")
        if title is not None and href is not None:
            found.append({"pos": n, "titulo": page.text_of(title), "href": href, "_p": None if text is None else page.text_of(text)})
    return found


_cards = _page_column(_cards_of, titulo=pa.string(), href=pa.string(), _p=pa.string())


def extract_cards(pages: DataFrame, base_url: str | Column, keys: list[str]) -> DataFrame:
    """Program cards of a capture's pages, the first one per URL.

    The first card of a URL decides, even if its title then turns out too
    short. ``page_ord`` orders the pages of a capture.
    """
    kept = [c for c in pages.columns if c != "html"]
    rows = compute_once(pages, _leido=_cards(F.col("html"))).select(*kept, F.inline("_leido"))
    read = rows.where(F.col("href").contains("/programas/"))
    firsts = first_per_url(
        read.withColumn("url_detalle", resolve_url(F.col("href"), base_of(base_url))),
        keys,
        ["page_ord", "pos"],
    )
    description = F.col("_p")
    segment = F.nullif(last_segment(F.col("href")), F.lit(""))
    return firsts.where(F.length("titulo") >= 3).select(
        *kept,
        "pos",
        F.coalesce(segment, surrogate_id(fixed.CARD_ID, F.col("titulo"))).alias("identificador"),
        "titulo",
        description.alias("descripcion"),
        "url_detalle",
        normalize_status(F.concat_ws(" ", "titulo", description)).alias("estado"),
    )


def extract_links(pages: DataFrame, base_url: str | Column, keys: list[str]) -> DataFrame:
    """Alliance calls given as links; the first one per URL of a capture."""
    kept = [c for c in pages.columns if c != "html"]
    href, text = F.col("href"), F.col("texto")
    wanted = (
        href.contains(fixed.ALLIANCE_PATH)
        & (href != fixed.ALLIANCE_INDEX)
        & (href != F.concat(F.regexp_replace(base_of(base_url), "/+$", ""), F.lit(fixed.ALLIANCE_INDEX)))
        & ~href.contains("edit")
        & ~href.contains("readid")
        & ~F.contains(F.lower(href), F.lit("readspeaker"))
        & (F.length(text) >= 15)
    )
    rows = page_links(pages).where(wanted)
    firsts = first_per_url(
        rows.withColumn("url_detalle", resolve_url(href, base_of(base_url))), keys, ["page_ord", "pos"]
    )
    segment = last_segment(href)
    return firsts.where((segment != "") & (segment != fixed.ALLIANCE_PAGE)).select(
        *kept,
        "pos",
        F.concat(F.lit(fixed.ALLIANCE_ID), segment).alias("identificador"),
        text.alias("titulo"),
        F.concat(F.lit(fixed.ALLIANCE_TEXT), text).alias("descripcion"),
        "url_detalle",
        normalize_status(text).alias("estado"),
    )


# --- news -----------------------------------------------------------------------
NEWS_LINKS = "a[href*='sala-de-prensa']"
#: The element this many levels above a news link holds its date and text.
NEWS_LEVELS = 6


def _news_of(html: str) -> list[dict]:
    """A page's news links whose href and title are both new, in page order, each with the text around it."""
    page = RulePage(html)
    hrefs, titles, found = set(), set(), []
    for at in page.all(NEWS_LINKS):
        href, title = page.named[at]["href"], page.text_of(at)
        if len(title) < 15 or href in hrefs or title in titles or any(x in href for x in ("facebook", "twitter", "flickr")):
            continue
        hrefs.add(href)
        titles.add(title)
        above = at
        for _ in range(NEWS_LEVELS):
            above = page.parent[above] if above >= 0 else -1
        found.append({"pos": at, "href": href, "titulo": title, "contexto": page.text_of(above, " ") if above >= 0 else None})
    return found


_news = _page_column(_news_of, href=pa.string(), titulo=pa.string(), contexto=pa.string())


def extract_news(pages: DataFrame, base_url: str | Column) -> DataFrame:
    """News links with the date and text around them, the relevant ones only."""
    kept = [c for c in pages.columns if c != "html"]
    rows = compute_once(pages, _leido=_news(F.col("html"))).select(*kept, F.inline("_leido"))
    title, context = F.col("titulo"), F.coalesce("contexto", F.lit(""))
    dated = compute_once(
        rows, _date=strip(F.regexp_extract(context, "(?U)" + fixed.NEWS_DATE, 0))
    )
    body = F.replace(context, title, F.lit(""))
    date = F.col("_date")
    body = F.when(date == "", body).otherwise(F.replace(body, date, F.lit("")))
    body = strip(F.regexp_replace(strip(body), "(?U)" + fixed.NEWS_LEFTOVERS, ""))
    read = compute_once(dated, _body=body)
    both = F.concat_ws(" ", title, F.col("_body"))
    return read.where(both.rlike(any_of(fixed.NEWS_KEYWORDS))).select(
        *kept,
        "pos",
        F.coalesce(
            F.nullif(F.try_url_decode(F.replace(last_segment(F.col("href")), F.lit("+"), F.lit("%2B"))), F.lit("")),
            surrogate_id(fixed.NEWS_ID, title),
        ).alias("identificador"),
        "titulo",
        F.nullif("_body", F.lit("")).alias("descripcion"),
        resolve_url(F.col("href"), base_of(base_url)).alias("url_detalle"),
        normalize_status(both).alias("estado"),
        blank_to_null(F.regexp_extract(both, "(?U)" + fixed.NEWS_DATE, 0)).alias("fecha_cierre"),
        "href",
    )


def extract_featured(pages: DataFrame, base_url: str | Column, keys: list[str]) -> DataFrame:
    """Featured program links; the first one per href of a page."""
    kept = [c for c in pages.columns if c != "html"]
    href, text = F.col("href"), F.col("texto")
    segment = last_segment(href)
    rows = page_links(pages).where(
        href.contains("/programas/divisi")
        & ~F.contains(F.lower(segment), F.lit("division"))
        & (F.length(text) >= 5)
    )
    return dedupe_first(rows, [*keys, "href"], ["pos"]).select(
        *kept,
        "pos",
        F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))).alias("identificador"),
        text.alias("titulo"),
        F.concat(F.lit(fixed.FEATURED_TEXT), text).alias("descripcion"),
        resolve_url(href, base_of(base_url)).alias("url_detalle"),
        F.lit(fixed.UNKNOWN_STATUS).alias("estado"),
        "href",
    )


# --- whole pages ------------------------------------------------------------------
NOISE_TAGS, NOISE_CLASSES = frozenset(fixed.NOISE_TAGS), frozenset(fixed.NOISE_CLASSES)


def _clean_batch(pages: pa.Array) -> pa.Array:
    return pa.array(["\n".join(readable(html or "", NOISE_TAGS, NOISE_CLASSES)) for html in pages.to_pylist()], pa.string())


_clean = F.arrow_udf(_clean_batch, T.StringType())


def clean_pages(pages: DataFrame) -> DataFrame:
    """Readable text of each page: navigation, scripts, ads and the like left out."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, squeeze_blank(_clean(F.col("html"))).alias("texto"))


def item_fragments(items: DataFrame) -> DataFrame:
    """A short text per item for a reader with a limited budget."""

    def line(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f"- {name}: "), F.col(name)))

    names = [f for f in fixed.RESPONSE_FIELDS if f in items.columns and f != "url_detalle"] + ["url_detalle"]
    head = F.concat(F.lit("### Item "), (F.col("pos") + 1).cast("string"))
    return items.withColumn("fragmento", F.concat_ws("\n", head, *[line(n) for n in names]))
