"""Queries over the bucketed store: upserts that touch few files, deletes of several tables at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from atalaya.operators import mutate, rollups
from atalaya.operators.changes import KEY
from atalaya.plans import state  # noqa: F401  (its checks are used here)
from atalaya.plans.registry import CHECKS, query
from atalaya.plans.tables import AS_OF, cte, view
from atalaya.session import shared_folder
from atalaya.sources import lookups
from atalaya.sources import store as stores

C = F.col
#: Tables of the store and the views that fill them.
VIEWS = {
    "fuentes": "fuentes", "snapshots": "capturas", "convocatorias": "convocatorias", "historial_cambios": "historial",
    "notificaciones": "notificaciones", "audit_logs": "auditoria",
}


@query("upsert_incremental", CHECKS["upsert_calls"])
def upsert_incremental(spark, d):
    """Stored calls as buckets, then the run's calls merged into the buckets they touch."""
    old, new = view(spark, d, "guardadas"), view(spark, d, "nuevas")
    store = stores.Store(spark, shared_folder(spark, "calls"), {"convocatorias": KEY}, {"convocatorias": old.schema}, 16)
    first = store.begin()
    first.put("convocatorias", old)
    first.commit()
    stores.upsert_incremental(store, "convocatorias", new, lambda stored, own: mutate.upsert_calls(stored, own, AS_OF))
    return store.read("convocatorias").select(
        "id", "fuente_id", "titulo", "descripcion", "estado", "fecha_cierre",
        C("monto").cast("double").alias("monto"), "region", "creado_en", "actualizado_en",
    )


_FREE = """x as (select id from fuentes where not activa and id not in (select c.fuente_id from capturas c
    join historial h on h.snapshot_id = c.id join convocatorias k on k.id = h.convocatoria_id where k.fuente_id <> c.fuente_id))"""


@query(
    "delete_versioned",
    f"""{cte('fuentes', 'capturas', 'convocatorias', 'historial', 'notificaciones', 'auditoria')}, {_FREE},
        h as (select id from historial where convocatoria_id not in (select id from convocatorias where fuente_id in (select id from x)))
        select 'fuentes' as tabla, id, cast(null as bigint) as fuente_id from fuentes where id not in (select id from x)
        union all select 'snapshots', id, fuente_id from capturas where fuente_id not in (select id from x)
        union all select 'convocatorias', id, fuente_id from convocatorias where fuente_id not in (select id from x)
        union all select 'historial_cambios', id, null from h
        union all select 'notificaciones', id, null from notificaciones where historial_cambios_id in (select id from h)
        union all select 'audit_logs', id, case when fuente_id not in (select id from x) then fuente_id end from auditoria
        union all select 'bloqueos', sign(count(*)), null from historial h join convocatorias k on k.id = h.convocatoria_id join capturas c
        on c.id = h.snapshot_id where c.fuente_id in (select id from fuentes where not activa) and k.fuente_id in (select id from fuentes where activa)""",
)
def delete_versioned(spark, d):
    """Inactive sources go with all that hangs on them, in one commit; before that one refused and one lost change.

    Sources whose captures other sources' events point to cannot go, so the first try is refused as a whole.
    """
    tables = {table: view(spark, d, name) for table, name in VIEWS.items()}
    store = stores.Store(
        spark, shared_folder(spark, "state"), {t: ["id"] for t in tables}, {t: rows.schema for t, rows in tables.items()}, 4
    )
    first = store.begin()
    for table, rows in tables.items():
        first.put(table, rows)
    first.commit()
    refused = 0
    try:
        stores.delete_sources(store, ~C("activa"))
    except stores.Restricted:
        refused = 1
    other = store.read("historial_cambios").select(C("convocatoria_id"), C("snapshot_id"))
    calls = store.read("convocatorias").select(C("id").alias("convocatoria_id"), C("fuente_id").alias("de"))
    captures = store.read("snapshots").select(C("id").alias("snapshot_id"), C("fuente_id").alias("fuente"))
    blocked = other.join(calls, "convocatoria_id").join(captures, "snapshot_id").where("de <> fuente").select("fuente").distinct()
    free = store.read("fuentes").where(~C("activa")).join(blocked, C("id") == C("fuente"), "left_anti").select("id")
    for commit in (False, True):  # the first one's files are written, but it is lost before its commit
        stores.delete_sources(store, free, commit=commit)
        store.recover()
    parts = [spark.range(refused, refused + 1).select(F.lit("bloqueos").alias("tabla"), "id", F.lit(None).cast("bigint").alias("fuente_id"))]
    for table in tables:
        rows = store.read(table)
        source = C("fuente_id") if "fuente_id" in rows.columns else F.lit(None)
        parts.append(rows.select(F.lit(table).alias("tabla"), C("id").cast("bigint").alias("id"), source.cast("bigint").alias("fuente_id")))
    return mutate.union_items(*parts)


@query(
    "lookup_call_pruned",
    f"{cte('convocatorias')} select id, titulo, estado from convocatorias where id = (select max(id) from convocatorias)",
)
def lookup_call_pruned(spark, d):
    """The key of the newest call, found again in a layout of sixteen folders; its neighbour's key is absent."""
    calls = view(spark, d, "convocatorias")
    path = shared_folder(spark, "lookups")
    lookups.write_lookup(calls, path, KEY, 16)
    newest = calls.agg(F.max_by(F.struct(*KEY), "id").alias("clave")).select("clave.*").first()
    absent = (newest[0], f"{newest[1]}-0")
    return lookups.lookup(spark, path, calls.schema, KEY, newest, absent, buckets=16).select("id", "titulo", "estado")


@query(
    "window_counts_merged",
    f"""{cte('convocatorias')}, x as (select region, count(*) as total, count(*) filter (estado = 'ABIERTO') as abiertas, count(*) filter (estado = 'CERRADO') as cerradas
        from convocatorias where cast(fecha_cierre as date) between date '1997-01-01' and date '1998-06-30' or fecha_cierre is null group by 1)
        select *, true as instituciones_bien from x""",
)
def window_counts_merged(spark, d):
    """Partials of old and new calls merged, then one window of days; the sources' estimate is held against their exact number."""
    calls = view(spark, d, "convocatorias")
    counts = {"total": None, "abiertas": C("estado") == "ABIERTO", "cerradas": C("estado") == "CERRADO"}
    old, new = (
        rollups.daily_partials(part, "fecha_cierre", ["region"], counts, {"instituciones": "fuente_id"})
        for part in (calls.where("id % 3 = 0"), calls.where("id % 3 > 0"))
    )
    path = shared_folder(spark, "partials")
    rollups.merge_partials(old, new, ["region"]).write.parquet(path)
    found = rollups.over_window(spark.read.parquet(path), "1997-01-01", "1998-06-30", ["region"], undated=True)
    inside = C("fecha_cierre").cast("date").between("1997-01-01", "1998-06-30") | C("fecha_cierre").isNull()
    exact = calls.where(inside).groupBy("region").agg(F.count_distinct("fuente_id").alias("exactas"))
    error = 3 * 1.04 / 2 ** (rollups.LG_K / 2)
    right = F.abs(C("instituciones") - C("exactas")) <= F.greatest(C("exactas") * error, F.lit(1))
    both = found.alias("f").join(exact.alias("e"), C("f.region").eqNullSafe(C("e.region")))
    return both.select("f.region", "total", "abiertas", "cerradas", right.alias("instituciones_bien"))
