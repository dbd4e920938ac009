"""Items out of RSS and Atom captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.amounts import find_amount
from atalaya.functions.dates import find_date
from atalaya.functions.status import normalize_status
from atalaya.functions.text import any_of, compute_once, strip, surrogate_id

VALUE = "struct<_VALUE:string,_href:string>"
VALUES = f"array<{VALUE}>"  # an element may repeat; the first one counts
RSS_ITEM = (
    f"struct<title:{VALUES},link:{VALUES},description:{VALUES},"
    f"`content:encoded`:{VALUES},summary:{VALUES},pubDate:{VALUES},`dc:date`:{VALUES},published:{VALUES}>"
)
ATOM_ENTRY = (
    f"struct<title:{VALUES},link:{VALUES},description:{VALUES},`content:encoded`:{VALUES},"
    f"summary:{VALUES},content:{VALUES},published:{VALUES},updated:{VALUES}>"
)
FEED = (
    f"struct<channel:array<struct<item:array<{RSS_ITEM}>>>,item:array<{RSS_ITEM}>,"
    f"entry:array<{ATOM_ENTRY}>,_corrupt_record:string>"
)
ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:([\w.-]+):)?([\w.-]+)"


def _plain(html: Column) -> Column:
    return strip(F.regexp_replace(html, "<[^>]+>", ""))


def _item(e: Column, atom: bool) -> Column:
    """Fields of an entry; the first description element that is there counts, and of repeated elements the first."""

    def first(name: str) -> Column:
        return F.get(e[name], F.lit(0))

    names = ["description", "content:encoded", "summary"] + (["content"] if atom else [])
    body = F.coalesce(*[first(n) for n in names])["_VALUE"]
    dates = ["published", "updated"] if atom else ["pubDate", "dc:date", "published"]
    link = strip(F.coalesce(first("link")["_VALUE"], F.lit("")))
    link = F.when(link == "", F.coalesce(first("link")["_href"], F.lit(""))).otherwise(link)
    return F.struct(
        F.coalesce(strip(first("title")["_VALUE"]), F.lit("")).alias("titulo"),
        F.coalesce(_plain(body), F.lit("")).alias("texto"),
        link.alias("link"),
        strip(F.coalesce(*[first(n) for n in dates])["_VALUE"]).alias("publicado"),
    )


def read_feeds(
    captures: DataFrame, body: str = "contenido_crudo", max_items: int | None = None
) -> DataFrame:
    """Captures with their ``entries`` array and a ``reject_reason``.

    Broken XML and other roots reject the capture; so does a feed that has
    items but not one of them usable. A namespace prefix of the root element
    is taken off its elements; the items of all channels count, in order.
    """
    root, prefix = F.regexp_extract(body, ROOT, 2), F.regexp_extract(body, ROOT, 1)
    prefixed = F.concat(F.lit(r"<(/?)\Q"), prefix, F.lit(r"\E:"))
    plain = F.when(prefix != "", F.regexp_replace(F.col(body), prefixed, F.lit("<$1"))).otherwise(F.col(body))
    doc = F.from_xml(
        plain, FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    read = compute_once(captures, _root=root, _doc=doc)
    none = F.array().cast(f"array<{RSS_ITEM}>")
    listed = F.transform(F.col("_doc.channel"), lambda c: F.coalesce(c["item"], none))
    found = F.concat(F.coalesce(F.flatten(listed), none), F.coalesce(F.col("_doc.item"), none))
    rss = F.transform(found, lambda e: _item(e, atom=False))
    atom = F.transform(F.col("_doc.entry"), lambda e: _item(e, atom=True))
    entries = F.coalesce(F.when(F.col("_root") == "rss", rss).otherwise(atom), F.array().cast(
        "array<struct<titulo:string,texto:string,link:string,publicado:string>>"
    ))
    keyword = any_of(fixed.FEED_KEYWORDS)
    usable = lambda e: (
        F.concat_ws(" ", e.titulo, e.texto).rlike(keyword) & (e.titulo != "")
    )
    listed = compute_once(read, _all=entries)
    listed = compute_once(listed, _usable=F.filter("_all", usable))
    reason = (
        F.when(F.col("_doc._corrupt_record").isNotNull() | (F.col("_root") == ""), "xml_invalido")
        .when(~F.col("_root").isin("rss", "feed"), "no_es_feed")
        .when((F.size("_all") > 0) & (F.size("_usable") == 0), "sin_items")
    )
    return listed.withColumns(
        {
            "entries": F.col("_usable") if max_items is None else F.slice("_usable", 1, max_items),
            "reject_reason": reason,
        }
    ).drop("_root", "_doc", "_all", "_usable", body)


def extract_feed(
    captures: DataFrame, body: str = "contenido_crudo", max_items: int | None = None
) -> DataFrame:
    """Relevant items of every good feed, or the first ``max_items`` of each.

    A limit works on the capture's array, so no rows of a source have to meet.
    """
    feeds = read_feeds(captures, body, max_items).where("reject_reason IS NULL")
    kept = [c for c in feeds.columns if c not in ("entries", "reject_reason")]
    rows = feeds.select(*kept, F.posexplode("entries").alias("pos", "e")).select(*kept, "pos", "e.*")
    both = F.concat_ws(" ", "titulo", "texto")
    return rows.select(
        *kept,
        "pos",
        F.when(F.col("link") != "", F.col("link"))
        .otherwise(surrogate_id(fixed.FEED_ID, F.col("titulo")))
        .alias("identificador"),
        "titulo",
        F.nullif("texto", F.lit("")).alias("descripcion"),
        F.nullif(F.col("link"), F.lit("")).alias("url_detalle"),
        normalize_status(both).alias("estado"),
        find_date(both).alias("fecha_cierre"),
        find_amount(both).alias("monto"),
    )
