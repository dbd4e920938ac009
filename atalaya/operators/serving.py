"""Lists, lookups and child records served over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.dates import at
from atalaya.functions.text import contains_fold
from atalaya.operators.filters import call_predicate

UNKNOWN_SOURCE = "Desconocido"


def with_source_name(df: DataFrame, sources: DataFrame, default: str = UNKNOWN_SOURCE) -> DataFrame:
    """Add the source's name, with a default where the source is unknown."""
    names = sources.select(F.col("id").alias("fuente_id"), F.col("nombre").alias("fuente_nombre"))
    return df.join(names, "fuente_id", "left").withColumn(
        "fuente_nombre", F.coalesce("fuente_nombre", F.lit(default))
    )


def calls_by_source_name(calls: DataFrame, sources: DataFrame, text: str) -> DataFrame:
    """Calls of the sources whose name contains a text; no such source, no rows."""
    wanted = sources.where(contains_fold(F.col("nombre"), text)).select(
        F.col("id").alias("fuente_id")
    )
    return calls.join(wanted, "fuente_id", "left_semi")


def select_calls(
    calls: DataFrame,
    sources: DataFrame | None = None,
    estado: str | None = None,
    region: str | None = None,
    fuente_id=None,
    fuente_nombre: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """The one filter behind both the list and its count.

    A source id goes before a source name, but a name that no source has
    gives no rows even then.
    """
    found = calls.where(call_predicate(estado, region, fuente_id, search))
    if not fuente_nombre:
        return found
    if fuente_id is None:
        return calls_by_source_name(found, sources, fuente_nombre)
    any_match = sources.where(contains_fold(F.col("nombre"), fuente_nombre)).agg(
        F.count("*").alias("n")
    )
    return found.where(any_match.scalar() > 0)


def ordered(calls: DataFrame, mode: str = "actualizacion", as_of=None) -> DataFrame:
    """One of the three orders of the list, with the id to break ties."""
    if mode == "por_vencer":
        return calls.where(F.col("fecha_cierre") >= at(as_of)).orderBy("fecha_cierre", "id")
    column = "creado_en" if mode == "recientes_creacion" else "actualizado_en"
    return calls.orderBy(F.desc(column), "id")


def page_calls(
    calls: DataFrame, mode: str = "actualizacion", limit: int = 50, offset: int = 0, as_of=None
) -> DataFrame:
    """One page of the list."""
    if not 1 <= limit <= fixed.LIST_MAX_ROWS or offset < 0:
        raise ValueError(f"limit must be 1..{fixed.LIST_MAX_ROWS} and offset not negative")
    return ordered(calls, mode, as_of).offset(offset).limit(limit)


def page_calls_after(calls: DataFrame, last: tuple[object, object], mode: str = "actualizacion", limit: int = 50, as_of=None) -> DataFrame:
    """The page behind a row, given by its (ordering value, id): however deep, a task holds ``limit`` rows only."""
    value, last_id = F.lit(last[0]), F.lit(last[1])
    column = {"por_vencer": "fecha_cierre", "recientes_creacion": "creado_en"}.get(mode, "actualizado_en")
    further = F.col(column) > value if mode == "por_vencer" else (F.col(column) < value) | F.col(column).isNull() & value.isNotNull()
    same = F.col(column).eqNullSafe(value) & (F.col("id") > last_id)
    return ordered(calls.where(further | same), mode, as_of).limit(limit)


def page_count(calls: DataFrame, size: int = fixed.LIST_PAGE_SIZE) -> DataFrame:
    return calls.agg(F.ceil(F.count("*") / size).alias("paginas"))


def newest(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """The newest rows of a log, notification or settings table."""
    return df.orderBy(F.desc(column), "id").limit(limit)


def audit_tail(
    audit: DataFrame, sources: DataFrame, nivel: str | None = None, limit: int = 50
) -> DataFrame:
    """Newest audit rows, of one level if given, with the source name if any."""
    rows = newest(audit.where(F.col("nivel") == nivel) if nivel else audit, "creado_en", limit)
    named = with_source_name(rows, sources)
    return named.withColumn(
        "fuente_nombre", F.when(F.col("fuente_id").isNotNull(), F.col("fuente_nombre"))
    )


def left_join_hot_right(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join whose *right* side may have very hot keys.

    A hot right side of an outer join cannot be split, so matched rows come
    from an inner join (AQE splits either side of it) and unmatched ones from
    an anti join against the distinct keys, which combine before the shuffle.
    """
    matched = left.join(right, keys)
    alone = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def call_detail(
    calls: DataFrame, sources: DataFrame, history: DataFrame, which: Column | None = None
) -> DataFrame:
    """Calls with their change events, one row per event (NULLs where none).

    Order the rows of a call by ``fecha_deteccion`` descending for display.
    """
    wanted = calls if which is None else calls.where(which)
    events = history.select(
        F.col("convocatoria_id").alias("id"),
        F.col("id").alias("evento_id"),
        F.when(F.col("es_apertura"), "APERTURA").otherwise("MODIFICACION").alias("tipo"),
        "es_relevante",
        "fecha_deteccion",
        "delta",
    )
    if which is not None:
        events = events.join(wanted.select("id"), "id", "left_semi")
    return left_join_hot_right(with_source_name(wanted, sources), events, ["id"])


def events_of_call(history: DataFrame, convocatoria_id) -> DataFrame:
    """One call's events, newest first."""
    return history.where(F.col("convocatoria_id") == convocatoria_id).orderBy(
        F.desc("fecha_deteccion"), "id"
    )
