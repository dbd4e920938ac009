"""Set-based changes of stored tables: each returns the table's next version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.dates import at
from atalaya.operators.changes import KEY

OVERWRITTEN = [
    "titulo", "descripcion", "url_detalle", "fecha_apertura", "fecha_cierre",
    "monto", "region", "estado", "actualizado_en",
]


def upsert_calls(stored: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Next version of the calls: update where the key exists, else insert.

    An update keeps ``id`` and ``creado_en`` and overwrites the business
    fields; stored rows the run does not have stay as they are. ``metadatos``
    is carried where the tables have it; a run without it leaves the stored one.
    """
    fields = OVERWRITTEN[:-1]
    now = at(as_of)
    meta = {side: ["metadatos"] if "metadatos" in t.columns else [] for side, t in (("n", new), ("s", stored))}
    incoming = new.select(*KEY, F.struct("id", *fields, *meta["n"]).alias("n"))
    current = stored.select(
        *KEY, F.struct("id", *fields, *meta["s"], "creado_en", "actualizado_en").alias("s")
    )
    carried = []
    if meta["n"] and meta["s"]:
        carried = [F.when(F.col("n").isNotNull(), F.col("n.metadatos")).otherwise(F.col("s.metadatos"))]
    elif meta["n"] or meta["s"]:
        carried = [F.col("n.metadatos" if meta["n"] else "s.metadatos")]
    touched = F.col("n").isNotNull()
    return current.join(incoming, KEY, "full").select(
        F.coalesce(F.col("s.id"), F.col("n.id")).alias("id"),
        *KEY,
        *[F.when(touched, F.col(f"n.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in fields],
        *[c.alias("metadatos") for c in carried],
        F.coalesce(F.col("s.creado_en"), now).alias("creado_en"),
        F.when(touched, now).otherwise(F.col("s.actualizado_en")).alias("actualizado_en"),
    )


def sync_sources(stored: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """Insert or overwrite sources by unique name; id and ``activa`` survive."""
    now = at(as_of)
    incoming = rules.select("nombre", F.struct("url_base", "config").alias("n"))
    current = stored.select(
        "nombre", F.struct("id", "url_base", "config", "activa", "creado_en", "actualizado_en").alias("s")
    )
    touched = F.col("n").isNotNull()
    new_id = F.sha2(F.col("nombre"), 256)
    return current.join(incoming, "nombre", "full").select(
        F.coalesce(F.col("s.id").cast("string"), new_id).alias("id"),
        "nombre",
        F.coalesce(F.col("n.url_base"), F.col("s.url_base")).alias("url_base"),
        F.coalesce(F.col("n.config"), F.col("s.config")).alias("config"),
        F.coalesce(F.col("s.activa"), F.lit(True)).alias("activa"),
        F.coalesce(F.col("s.creado_en"), now).alias("creado_en"),
        F.when(touched, now).otherwise(F.col("s.actualizado_en")).alias("actualizado_en"),
    )


def toggle_active(table: DataFrame, which) -> DataFrame:
    """Flip ``activa`` on the rows a condition names."""
    return table.withColumn("activa", F.when(which, ~F.col("activa")).otherwise(F.col("activa")))


def union_items(*tables: DataFrame) -> DataFrame:
    """Items of several extractors or pages; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def expired_calls(calls: DataFrame, as_of, days: int = fixed.RETENTION_DAYS):
    limit = at(as_of) - F.make_dt_interval(F.lit(days))
    return (F.col("creado_en") < limit) & (F.col("estado") != "ABIERTO")


def retention_purge(
    calls: DataFrame,
    events: DataFrame,
    notifications: DataFrame,
    as_of,
    days: int = fixed.RETENTION_DAYS,
) -> dict[str, DataFrame]:
    """Old calls that are not open go, with their events and notifications."""
    gone = expired_calls(calls, as_of, days)
    return delete_calls(calls, events, notifications, gone)


def delete_calls(calls, events, notifications, which) -> dict[str, DataFrame]:
    """Delete the calls a condition names and everything that hangs on them."""
    hit = F.coalesce(which, F.lit(False))
    dead_calls = calls.where(hit).select(F.col("id").alias("convocatoria_id"))
    dead_events = events.join(dead_calls, "convocatoria_id", "left_semi").select(
        F.col("id").alias("historial_cambios_id")
    )
    return {
        "convocatorias": calls.where(~hit),
        "historial_cambios": events.join(dead_calls, "convocatoria_id", "left_anti"),
        "notificaciones": notifications.join(dead_events, "historial_cambios_id", "left_anti"),
        "eliminadas": calls.where(hit).agg(F.count("*").alias("eliminadas")),
    }


def delete_sources(
    sources: DataFrame,
    captures: DataFrame,
    calls: DataFrame,
    events: DataFrame,
    notifications: DataFrame,
    audit: DataFrame,
    which,
) -> dict[str, DataFrame]:
    """Delete sources with captures and calls; audit rows only lose the reference.

    Events may not outlive their capture, so ``bloqueos`` counts the events of
    other sources' calls that point to a capture about to go: it must be zero.
    """
    dead = sources.where(F.coalesce(which, F.lit(False))).select(F.col("id").alias("fuente_id"))
    dead_calls = calls.join(dead, "fuente_id", "left_semi")
    dead_captures = captures.join(dead, "fuente_id", "left_semi")
    call_ids = dead_calls.select(F.col("id").alias("convocatoria_id"))
    dead_events = events.join(call_ids, "convocatoria_id", "left_semi")
    kept_events = events.join(call_ids, "convocatoria_id", "left_anti")
    marked = dead.withColumn("_dead", F.lit(True))
    return {
        "fuentes": sources.where(~F.coalesce(which, F.lit(False))),
        "snapshots": captures.join(dead, "fuente_id", "left_anti"),
        "convocatorias": calls.join(dead, "fuente_id", "left_anti"),
        "historial_cambios": kept_events,
        "notificaciones": notifications.join(
            dead_events.select(F.col("id").alias("historial_cambios_id")),
            "historial_cambios_id",
            "left_anti",
        ),
        "audit_logs": audit.join(marked, "fuente_id", "left")
        .withColumn("fuente_id", F.when(F.col("_dead").isNull(), F.col("fuente_id")))
        .drop("_dead"),
        "bloqueos": kept_events.join(
            dead_captures.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi"
        ).agg(F.count("*").alias("bloqueos")),
    }


def truncate(table: DataFrame) -> DataFrame:
    """The empty table of the same schema."""
    return table.where(F.lit(False))
