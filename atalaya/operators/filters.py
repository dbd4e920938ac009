"""Row filters over items and calls.

Each filter comes as a column (``*_reason``, NULL = keep) and as a table
operator, so that kept rows, rejected rows and counts per reason come out of
one narrow pass without a shuffle of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.dates import at, months_before, parse_date_es
from atalaya.functions.status import normalize_status
from atalaya.functions.text import any_of, compute_once, contains_fold


# --- relevance --------------------------------------------------------------
def is_excluded_title(title: Column) -> Column:
    return F.coalesce(title.rlike(any_of(fixed.EXCLUDED_TITLES)), F.lit(False))


def has_funding_signal(title: Column, description: Column) -> Column:
    """Informative only: it never changes which rows are kept."""
    return F.concat_ws(" ", title, description).rlike(any_of(fixed.FUNDING_SIGNALS))


def title_year_is_recent(title: Column, as_of, months: int = fixed.LIVENESS_MONTHS) -> Column:
    """False where any year in the title is before the window; no year is fine."""
    first_year = F.year(months_before(at(as_of), months))
    years = F.regexp_extract_all(title, F.lit("(?U)" + fixed.TITLE_YEAR), F.lit(1))
    return F.coalesce(F.forall(years, lambda y: y.cast("int") >= first_year), F.lit(True))


def relevance_reason(title: Column, as_of, months: int = fixed.LIVENESS_MONTHS) -> Column:
    return F.when(is_excluded_title(title), "exclusion").when(
        ~title_year_is_recent(title, as_of, months), "fecha_titulo"
    )


def filter_relevant(df: DataFrame) -> DataFrame:
    return df.where(~is_excluded_title(F.col("titulo"))).withColumn(
        "has_positive", has_funding_signal(F.col("titulo"), F.col("descripcion"))
    )


def filter_title_year(df: DataFrame, as_of, months: int = fixed.LIVENESS_MONTHS) -> DataFrame:
    return df.where(title_year_is_recent(F.col("titulo"), as_of, months))


def relevance_summary(df: DataFrame, as_of, months: int = fixed.LIVENESS_MONTHS) -> DataFrame:
    return _reason_counts(df, relevance_reason(F.col("titulo"), as_of, months))


# --- liveness ---------------------------------------------------------------
def liveness_reason(
    status: Column, closing: Column, as_of, months: int = fixed.LIVENESS_MONTHS
) -> Column:
    """Why a call is not live: by status, by age window or by date; NULL = live."""
    now = at(as_of)
    aged = F.when(closing < months_before(now, months), "ventana") if months > 0 else F.lit(None)
    none = F.lit(None).cast("string")
    reasons = {s: F.lit("estado") for s in fixed.CLOSED_STATUSES}
    reasons |= {s: F.coalesce(aged, none) for s in fixed.LIVE_STATUSES}
    reasons[fixed.UNKNOWN_STATUS] = F.when(closing < now, "fecha")
    by_status = F.create_map(*[x for s, r in reasons.items() for x in (F.lit(s), r)])
    return F.try_element_at(by_status, normalize_status(status))


def filter_live(df: DataFrame, as_of, months: int = fixed.LIVENESS_MONTHS) -> DataFrame:
    reason = liveness_reason(F.col("estado"), F.col("fecha_cierre"), as_of, months)
    return df.where(reason.isNull())


def filter_live_raw(df: DataFrame, as_of, months: int = fixed.LIVENESS_MONTHS) -> DataFrame:
    """Same over raw rows whose closing date is still text; unreadable dates keep."""
    read = compute_once(df, _closing=parse_date_es(F.col("fecha_cierre")))
    reason = liveness_reason(F.col("estado"), F.col("_closing"), as_of, months)
    return read.where(reason.isNull()).drop("_closing")


def live_summary(df: DataFrame, as_of, months: int = fixed.LIVENESS_MONTHS) -> DataFrame:
    return _reason_counts(
        df, liveness_reason(F.col("estado"), F.col("fecha_cierre"), as_of, months)
    )


def _reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    return (
        df.select(F.coalesce(reason, F.lit("vigente")).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
    )


# --- keywords, exclusion lists, markers --------------------------------------
def has_keyword(title: Column, body: Column, keywords: list[str]) -> Column:
    return F.concat_ws(" ", title, F.coalesce(body, F.lit(""))).rlike(any_of(keywords))


def filter_keywords(df: DataFrame, keywords: list[str] = fixed.FEED_KEYWORDS) -> DataFrame:
    return df.where(has_keyword(F.col("titulo"), F.col("descripcion"), keywords))


def is_excluded_by_rule(
    title: Column, url: Column, title_patterns: Column, url_parts: Column
) -> Column:
    """Title matches any pattern, or the URL contains any part, of the row's rule."""
    by_title = F.exists(
        title_patterns, lambda p: F.regexp_like(title, F.concat(F.lit("(?iU)"), p))
    )
    by_url = F.exists(url_parts, lambda p: F.contains(F.lower(url), F.lower(p)))
    return F.coalesce(by_title, F.lit(False)) | F.coalesce(by_url, F.lit(False))


def exclude_patterns(items: DataFrame, rules: DataFrame, key: str = "fuente_id") -> DataFrame:
    """Drop items that their source's exclusion lists name.

    Patterns travel as arrays on the one rule row of a source, so this is an
    equi join; AQE broadcasts the rules when their measured size allows it and
    splits a hot source otherwise.
    """
    lists = rules.select(key, "excluir_patrones_titulo", "excluir_patrones_url")
    hit = is_excluded_by_rule(
        F.col("titulo"),
        F.col("url_detalle"),
        F.col("excluir_patrones_titulo"),
        F.col("excluir_patrones_url"),
    )
    return items.join(lists, key, "left").where(~hit).select(*items.columns)


def is_explicitly_empty(body: Column, markers: Column) -> Column:
    """The page itself says that there is nothing: any marker, case ignored."""
    text = F.lower(body)
    return F.coalesce(F.exists(markers, lambda m: F.contains(text, F.lower(m))), F.lit(False))


# --- serving predicates -----------------------------------------------------
def call_predicate(
    estado: str | None = None,
    region: str | None = None,
    fuente_id=None,
    search: str | None = None,
) -> Column:
    """Conjunction of the given conditions; none given accepts every row."""
    tests = []
    if estado:
        tests.append(F.col("estado") == estado)
    if region:
        tests.append(F.col("region") == region)
    if fuente_id is not None:
        tests.append(F.col("fuente_id") == fuente_id)
    if search:
        tests.append(contains_fold(F.col("titulo"), search))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def due_soon(calls: DataFrame, as_of) -> DataFrame:
    """Calls still to close, the nearest first."""
    return calls.where(F.col("fecha_cierre") >= at(as_of)).orderBy("fecha_cierre", "id")


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where("activa")


def lookup_call(calls: DataFrame, fuente_id, identificador_externo: str) -> DataFrame:
    return calls.where(
        (F.col("fuente_id") == fuente_id)
        & (F.col("identificador_externo") == identificador_externo)
    )


def lookup_source(sources: DataFrame, id=None, nombre: str | None = None) -> DataFrame:
    return sources.where(F.col("id") == id if id is not None else F.col("nombre") == nombre)


def search_sources(sources: DataFrame, text: str) -> DataFrame:
    return sources.where(contains_fold(F.col("nombre"), text))
