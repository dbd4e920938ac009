"""Queries over stored tables: duplicates, changes, joins, counts, mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.operators import attempts, changes, dedupe, mutate, observed, outbox, reports, serving
from atalaya.plans.monitor import monitor_run
from atalaya.plans.registry import query
from atalaya.plans.rows import DAYS_SQL, DUCK_EXCLUDED, ITEM_STAGES, NOW, duck_liveness, item_rules
from atalaya.plans.tables import AS_OF, alerts, cte, read, spread, spread_items, view
from atalaya.session import shared_folder, small_splits, working_folder

C = F.col
ITEM_KEY = ["fuente_id", "identificador"]
ITEM_ORDER = ["cierre", "parte", "precio", "linea"]


# --- duplicates and latest rows ---------------------------------------------------
def _dedupe_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in ITEM_ORDER)
    return (
        f"{cte('items')} select fuente_id, identificador, cierre, parte from (select *, row_number() over "
        f"(partition by fuente_id, identificador order by {order}) as rn from items) where rn = 1"
    )


@query("dedupe_last", _dedupe_sql("desc"))
def dedupe_last(spark, d):
    rows = view(spark, d, "items")
    return dedupe.dedupe_last(rows, ITEM_KEY, ITEM_ORDER).select(*ITEM_KEY, "cierre", "parte")


@query("dedupe_first", _dedupe_sql("asc"))
def dedupe_first(spark, d):
    rows = view(spark, d, "items")
    return dedupe.dedupe_first(rows, ITEM_KEY, ITEM_ORDER).select(*ITEM_KEY, "cierre", "parte")


@query(
    "cap_per_group",
    """select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice from (select *, row_number() over (partition by l_suppkey
        order by l_shipdate desc, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rn from lineitem) where rn <= 50""",
)
def cap_per_group(spark, d):
    order = [F.desc("l_shipdate")] + [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    capped = dedupe.cap_per_group(read(spark, d, "lineitem"), ["l_suppkey"], order, 50)
    return capped.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "latest_snapshot",
    f"""{cte('capturas')} select id, fuente_id, fecha_captura, contenido_crudo from (select *, row_number() over
        (partition by fuente_id order by fecha_captura desc, id desc) as rn from capturas) where rn = 1""",
)
def latest_snapshot(spark, d):
    return dedupe.latest_snapshot(view(spark, d, "capturas"))


@query(
    "content_changed",
    f"""{cte('capturas')}, x as (select *, sha256(contenido_crudo) as h from capturas),
        y as (select *, lag(h) over (partition by fuente_id order by fecha_captura, id) as p from x)
        select id, fuente_id, h as hash_contenido, p as hash_anterior, h is distinct from p as cambio from y""",
)
def content_changed(spark, d):
    hashed = view(spark, d, "capturas").withColumn("hash_contenido", F.sha2("contenido_crudo", 256))
    flagged = dedupe.content_changed(hashed.drop("contenido_crudo"))
    return flagged.select("id", "fuente_id", "hash_contenido", "hash_anterior", "cambio")


# --- change detection -------------------------------------------------------------
_FIELDS = {
    "titulo": "{0}.titulo",
    "descripcion": "{0}.descripcion",
    "url_detalle": "{0}.url_detalle",
    "estado": "{0}.estado",
    "fecha_cierre": "strftime({0}.fecha_cierre, '%Y-%m-%d %H:%M:%S') || '+00:00'",
    "monto": "cast({0}.monto as varchar)",
}
_DELTAS_SQL = " union all ".join(
    f"select id, fuente_id, identificador_externo, {i} as n, '{f}' as campo, {sql.format('o')} as anterior, {sql.format('k')} as nuevo "
    f"from pares where o is not null and k.{f} is distinct from o.{f} and not list_contains(string_split(ignorados, ','), '{f}')"
    for i, (f, sql) in enumerate(_FIELDS.items())
)
CHANGES_SQL = f"""{cte('guardadas', 'nuevas', 'alertas')},
    pares as (select coalesce(o.id, k.id) as id, k.fuente_id, k.identificador_externo,
        case when o.id is not null then o end as o, k, sensibles, ignorados
        from nuevas k left join guardadas o using (fuente_id, identificador_externo) left join alertas using (fuente_id)),
    deltas as ({_DELTAS_SQL}),
    eventos as (select id as convocatoria_id, fuente_id, identificador_externo, 'APERTURA' as tipo, '' as campos, true as es_relevante
        from pares where o is null
        union all select d.id, d.fuente_id, d.identificador_externo, 'MODIFICACION', string_agg(campo, ',' order by n),
        bool_or(list_contains(string_split(sensibles, ','), campo)) from deltas d join alertas using (fuente_id) group by 1, 2, 3)"""


def _runs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(spark, d, "nuevas"), view(spark, d, "guardadas"), alerts(spark, d)


def _fields(deltas="deltas"):
    return F.array_join(F.transform(deltas, lambda x: x.campo), ",").alias("campos")


@query("detect_changes", f"{CHANGES_SQL} select * from eventos")
def detect_changes(spark, d):
    events = changes.detect_changes(*_runs(spark, d))
    return events.select("convocatoria_id", *changes.KEY, "tipo", _fields(), "es_relevante")


@query("detect_openings", f"{CHANGES_SQL} select id, fuente_id, identificador_externo from pares where o is null")
def detect_openings(spark, d):
    new, old, _ = _runs(spark, d)
    return changes.detect_openings(new, old).select("id", *changes.KEY)


@query(
    "detect_missing",
    f"""{cte('guardadas', 'nuevas')} select id, fuente_id, identificador_externo from guardadas o where not exists
        (select 1 from nuevas n where n.fuente_id = o.fuente_id and n.identificador_externo = o.identificador_externo)""",
)
def detect_missing(spark, d):
    new, old, _ = _runs(spark, d)
    return changes.detect_missing(new, old).select("id", *changes.KEY)


@query("field_deltas", f"{CHANGES_SQL} select id as convocatoria_id, cast(n as int) as n, campo, anterior, nuevo from deltas")
def field_deltas(spark, d):
    names = {f: i for i, f in enumerate(_FIELDS)}
    place = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    compared = changes.compare(*_runs(spark, d)).where(~C("es_apertura"))
    return compared.select("convocatoria_id", F.explode("deltas").alias("x")).select(
        "convocatoria_id",
        place[C("x.campo")].alias("n"),
        C("x.campo").alias("campo"),
        C("x.valor_anterior").alias("anterior"),
        C("x.valor_nuevo").alias("nuevo"),
    )


_HISTORY_SQL = """select convocatoria_id, tipo = 'APERTURA' as es_apertura, es_relevante,
    case when tipo = 'APERTURA' then 0 else len(string_split(campos, ',')) end as n_deltas from eventos"""


@query("event_log", f"{CHANGES_SQL} {_HISTORY_SQL}")
def event_log(spark, d):
    """History rows, read back from their JSON form."""
    log = changes.event_log(
        changes.detect_changes(*_runs(spark, d)), F.lit("run-1"), F.lit(AS_OF).cast("timestamp_ntz")
    )
    back = changes.read_deltas(log)
    return back.select(
        "convocatoria_id", "es_apertura", "es_relevante", F.size("deltas").cast("bigint").alias("n_deltas")
    )


@query(
    "upsert_calls",
    f"""{cte('guardadas', 'nuevas')} select coalesce(o.id, n.id) as id, coalesce(o.fuente_id, n.fuente_id) as fuente_id,
        case when n.id is not null then n.titulo else o.titulo end as titulo,
        case when n.id is not null then n.descripcion else o.descripcion end as descripcion,
        case when n.id is not null then n.estado else o.estado end as estado,
        case when n.id is not null then n.fecha_cierre else o.fecha_cierre end as fecha_cierre,
        cast(case when n.id is not null then n.monto else o.monto end as double) as monto,
        case when n.id is not null then n.region else o.region end as region,
        coalesce(o.creado_en, {NOW}) as creado_en,
        case when n.id is not null then {NOW} else o.actualizado_en end as actualizado_en
        from guardadas o full join nuevas n on o.fuente_id = n.fuente_id and o.identificador_externo = n.identificador_externo""",
)
def upsert_calls(spark, d):
    new, old, _ = _runs(spark, d)
    return mutate.upsert_calls(old, new, AS_OF).select(
        "id", "fuente_id", "titulo", "descripcion", "estado", "fecha_cierre",
        C("monto").cast("double").alias("monto"), "region", "creado_en", "actualizado_en",
    )


# --- a whole run ------------------------------------------------------------------
_RUN_ORDER = "cierre desc, parte desc, precio desc, linea desc"
RUN_SQL = f"""{ITEM_STAGES.replace('cierre, parte, precio,', 'cierre, parte, precio, linea,')},
    unicas as (select * from (select *, row_number() over (partition by fuente_id, identificador order by {_RUN_ORDER}) as rn
        from normales where reject_reason is null) where rn = 1),
    etapas as (select fuente_id, identificador, titulo, estado, fecha_cierre,
        case when {DUCK_EXCLUDED} then 'relevancia'
        when len(list_filter(regexp_extract_all(titulo, '\\b(20[0-2]\\d)\\b', 1), lambda y: cast(y as int) < 1998)) > 0 then 'relevancia'
        when ({duck_liveness('fecha_cierre', 'estado')}) is not null then 'vigencia' end as motivo from unicas
        union all select fuente_id, identificador, titulo, estado, fecha_cierre, 'normalizacion' from normales where reject_reason is not null)"""


def _monitor(spark, d, stages_path=None, items_path=None):
    """Stored state: what an earlier run took from the first item lines."""
    rules = item_rules(spark, d)
    items = view(spark, d, "items", wide=True, by=spread_items if items_path else spread).withColumn(
        "pos", F.struct("cierre", "parte", "precio", "linea")
    )
    sources = rules.select(
        "fuente_id",
        F.array(F.lit("estado")).alias("campos_sensibles"),
        F.array().cast("array<string>").alias("ignorar_cambios_en"),
    )
    stored = (
        read(spark, d, "lineitem")
        .where("l_quantity > 1")
        .groupBy(C("l_suppkey").alias("fuente_id"), F.concat_ws("-", F.concat(F.lit("L"), "l_orderkey"), "l_linenumber").alias("identificador_externo"))
        .agg(F.min("l_quantity").alias("q"))
        .where("q > 25")
    )
    nothing = F.lit(None).cast("string")
    never = F.lit(None).cast("timestamp_ntz")
    stored = stored.select(
        F.md5("identificador_externo").alias("id"), "fuente_id", "identificador_externo",
        F.lit("Programa").alias("titulo"), nothing.alias("descripcion"), nothing.alias("url_detalle"),
        never.alias("fecha_apertura"), never.alias("fecha_cierre"), F.lit(None).cast("decimal(15,2)").alias("monto"),
        nothing.alias("region"), F.lit("ABIERTO").alias("estado"), never.alias("creado_en"), never.alias("actualizado_en"),
    )
    return monitor_run(items, rules, sources, stored, AS_OF, ["pos"], stages_path=stages_path, items_path=items_path)


@query("monitor_run", f"{RUN_SQL} select fuente_id, identificador, titulo, estado, fecha_cierre from etapas where motivo is null")
def monitor(spark, d):
    return _monitor(spark, d).kept.select(
        "fuente_id", C("identificador_externo").alias("identificador"), "titulo", "estado", "fecha_cierre"
    )


@query(
    "run_summary",
    f"""{RUN_SQL}, previas as (select l_suppkey as fuente_id, 'L' || l_orderkey || '-' || l_linenumber as identificador
        from lineitem where l_quantity > 1 group by 1, 2 having min(l_quantity) > 25),
        ev as (select e.estado <> 'ABIERTO' or p.fuente_id is null as rel from etapas e left join previas p using (fuente_id, identificador) where motivo is null)
        select (select count(*) from etapas) as leidas, (select count(*) from etapas where motivo is null) as nuevas_encontradas,
        (select count(*) from etapas where motivo = 'normalizacion') as descartadas_normalizacion,
        (select count(*) from etapas where motivo = 'relevancia') as descartadas_relevancia,
        (select count(*) from etapas where motivo = 'vigencia') as descartadas_vigencia,
        (select count(*) from ev) as eventos_generados, (select count(*) from ev where rel) as eventos_relevantes""",
)
def run_summary(spark, d):
    """The stages are written once; counts and events read them."""
    with small_splits(spark), working_folder(spark, "items") as items_path:
        run = _monitor(spark, d, shared_folder(spark, "stages"), items_path)
    return run.summary()


@query(
    "run_counts_observed",
    f"""{RUN_SQL} select count(*) as leidas, count(*) filter (motivo is null) as nuevas_encontradas,
        count(*) filter (motivo = 'normalizacion') as descartadas_normalizacion, count(*) filter (motivo = 'relevancia') as descartadas_relevancia,
        count(*) filter (motivo = 'vigencia') as descartadas_vigencia, cast(0 as bigint) as descartadas_otras from etapas""",
)
def run_counts_observed(spark, d):
    """Counts of a run from the one write of its stages; no stage is read again."""
    with small_splits(spark), working_folder(spark, "items") as items_path:
        stages = _monitor(spark, d, items_path=items_path).stages
        counts = observed.write_observed(stages, shared_folder(spark, "run"))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} bigint" for name in counts))


# --- joins ------------------------------------------------------------------------
@query(
    "calls_with_source",
    f"""{cte('convocatorias', 'fuentes')} select c.id, coalesce(nombre, 'Desconocido') as fuente_nombre from convocatorias c
        left join fuentes f on f.id = fuente_id and f.activa""",
)
def calls_with_source(spark, d):
    known = view(spark, d, "fuentes").where("activa")
    return serving.with_source_name(view(spark, d, "convocatorias"), known).select("id", "fuente_nombre")


@query(
    "calls_by_source_name",
    f"""{cte('convocatorias', 'fuentes')} select id, titulo from convocatorias where fuente_id in
        (select id from fuentes where nombre ilike '%r#00000001%')""",
)
def calls_by_source_name(spark, d):
    found = serving.select_calls(view(spark, d, "convocatorias"), view(spark, d, "fuentes"), fuente_nombre="R#00000001")
    return found.select("id", "titulo")


@query(
    "call_detail",
    f"""{cte('convocatorias', 'fuentes', 'historial')} select c.id, coalesce(nombre, 'Desconocido') as fuente_nombre, c.titulo,
        h.id as evento_id, case when es_apertura then 'APERTURA' when not es_apertura then 'MODIFICACION' end as tipo, fecha_deteccion, delta
        from convocatorias c left join fuentes f on f.id = fuente_id left join historial h on h.convocatoria_id = c.id""",
)
def call_detail(spark, d):
    detail = serving.call_detail(view(spark, d, "convocatorias"), view(spark, d, "fuentes"), view(spark, d, "historial"))
    return detail.select("id", "fuente_nombre", "titulo", "evento_id", "tipo", "fecha_deteccion", "delta")


@query(
    "source_overview",
    f"""{cte('fuentes', 'convocatorias', 'capturas')} select id, nombre, activa, coalesce(total, 0) as total_convocatorias,
        coalesce(abi, 0) as abiertas, coalesce(cer, 0) as cerradas, ultima_ejecucion from fuentes
        left join (select fuente_id, count(*) as total, count(*) filter (estado = 'ABIERTO') as abi,
        count(*) filter (estado = 'CERRADO') as cer from convocatorias group by 1) c on c.fuente_id = id
        left join (select fuente_id, max(fecha_captura) as ultima_ejecucion from capturas group by 1) s on s.fuente_id = id""",
)
def source_overview(spark, d):
    overview = reports.source_overview(view(spark, d, "fuentes"), view(spark, d, "convocatorias"), view(spark, d, "capturas"))
    return overview.drop("url_base")


# --- counts and reports -----------------------------------------------------------
@query(
    "dashboard",
    f"""{cte('fuentes', 'convocatorias', 'historial')} select (select count(*) from fuentes) as total_fuentes,
        (select count(*) from fuentes where activa) as fuentes_activas, (select count(*) from convocatorias) as total_convocatorias,
        (select count(*) from convocatorias where estado = 'ABIERTO') as convocatorias_abiertas,
        (select count(*) from convocatorias where estado = 'CERRADO') as convocatorias_cerradas,
        (select count(*) from historial) as total_eventos, (select count(*) from historial where es_relevante) as eventos_relevantes""",
)
def dashboard(spark, d):
    return reports.dashboard(view(spark, d, "fuentes"), view(spark, d, "convocatorias"), view(spark, d, "historial"))


@query(
    "calls_per_source",
    f"""{cte('convocatorias')} select fuente_id, count(*) as total_convocatorias, count(*) filter (estado = 'ABIERTO') as abiertas,
        count(*) filter (estado = 'CERRADO') as cerradas from convocatorias group by 1""",
)
def calls_per_source(spark, d):
    return reports.calls_per_source(view(spark, d, "convocatorias"))


@query("last_capture", f"{cte('capturas')} select fuente_id, max(fecha_captura) as ultima_ejecucion from capturas group by 1")
def last_capture(spark, d):
    return reports.last_capture(view(spark, d, "capturas"))


@query(
    "count_calls",
    f"""{cte('convocatorias', 'fuentes')} select count(*) as total from convocatorias where estado = 'ABIERTO' and region = 'Metropolitana'
        and fuente_id in (select id from fuentes where nombre ilike '%r#000000%')""",
)
def count_calls(spark, d):
    found = serving.select_calls(
        view(spark, d, "convocatorias"), view(spark, d, "fuentes"),
        estado="ABIERTO", region="Metropolitana", fuente_nombre="r#000000",
    )
    return reports.count_calls(found)


@query("open_total", f"{cte('convocatorias')} select count(*) as abiertas_total from convocatorias where estado = 'ABIERTO'")
def open_total(spark, d):
    return reports.open_total(view(spark, d, "convocatorias"))


_QUALITY_SQL = f"""{cte('fuentes', 'convocatorias')}, q as (select nombre as fuente, coalesce(estrategia, 'desconocida') as estrategia,
    count(c.id) as n, count(fecha_cierre) as a, count(monto) as b, count(region) as r, count(descripcion) as e
    from fuentes f left join convocatorias c on c.fuente_id = f.id where activa group by all)"""


@query(
    "quality_report",
    f"""{_QUALITY_SQL} select fuente, estrategia, n as total_items, a / nullif(n, 0) * 100 as pct_cierre, b / nullif(n, 0) * 100 as pct_monto,
        r / nullif(n, 0) * 100 as pct_region, e / nullif(n, 0) * 100 as pct_desc from q""",
)
def quality_report(spark, d):
    return reports.quality_report(view(spark, d, "fuentes"), view(spark, d, "convocatorias"))


def _duck_pct(c: str) -> str:
    # Half-even to one digit, on exact thousandths: the printed form of a share.
    return f"case when n = 0 then '-' else format('{{:.1f}}', {c} / n * 100) || '%' end"


@query(
    "quality_report_md",
    f"""{_QUALITY_SQL} select fuente, '| ' || fuente || ' | `' || estrategia || '` | ' || n || ' | ' || {_duck_pct('a')} || ' | ' ||
        {_duck_pct('b')} || ' | ' || {_duck_pct('r')} || ' | ' || {_duck_pct('e')} || ' |' as linea from q""",
)
def quality_report_md(spark, d):
    return reports.quality_report_md(quality_report(spark, d))


@query(
    "kpis",
    f"""{cte('convocatorias')}, x as (select *, {DAYS_SQL} as dias from convocatorias where estado = 'ABIERTO')
        select count(*) as abiertas, count(*) filter (dias between 0 and 30) as vencen_30,
        count(distinct fuente_id) as instituciones, count(*) filter (fecha_cierre is null) as sin_fecha from x""",
)
def kpis(spark, d):
    return reports.kpis(view(spark, d, "convocatorias"), AS_OF)


@query(
    "briefing",
    f"""{cte('convocatorias', 'fuentes')}, x as (select c.*, nombre, {DAYS_SQL} as dias from convocatorias c join fuentes f on f.id = fuente_id
        where estado = 'ABIERTO' and fecha_cierre >= {NOW})
        select nombre as fuente_nombre, id, fecha_cierre, dias, count(*) over (partition by fuente_id) as activas,
        count(*) filter (dias between 0 and 30) over (partition by fuente_id) as cierran_30d from x""",
)
def briefing(spark, d):
    rows = reports.briefing(view(spark, d, "convocatorias"), view(spark, d, "fuentes"), AS_OF)
    return rows.select("fuente_nombre", "id", "fecha_cierre", "dias", "activas", "cierran_30d")


# --- lists ------------------------------------------------------------------------
@query(
    "page_calls",
    f"""{cte('convocatorias')} select id, titulo, fecha_cierre from convocatorias where fecha_cierre >= {NOW}
        order by fecha_cierre, id limit 50 offset 100""",
)
def page_calls(spark, d):
    page = serving.page_calls(view(spark, d, "convocatorias"), "por_vencer", 50, 100, AS_OF)
    return page.select("id", "titulo", "fecha_cierre")


@query(
    "audit_tail",
    f"""{cte('auditoria', 'fuentes')} select a.id, a.fuente_id, case when a.fuente_id is not null then coalesce(nombre, 'Desconocido') end as fuente_nombre,
        nivel, mensaje, a.creado_en from (select * from auditoria order by creado_en desc, id limit 200) a left join fuentes f on f.id = a.fuente_id""",
)
def audit_tail(spark, d):
    tail = serving.audit_tail(view(spark, d, "auditoria"), view(spark, d, "fuentes"), limit=200)
    return tail.select("id", "fuente_id", "fuente_nombre", "nivel", "mensaje", "creado_en")


@query(
    "notifications_tail",
    f"{cte('notificaciones')} select id, canal, destinatario, estado, enviado_en, error_log from notificaciones order by enviado_en desc, id limit 50",
)
def notifications_tail(spark, d):
    return serving.newest(view(spark, d, "notificaciones"), "enviado_en").drop("historial_cambios_id")


# --- notifications ----------------------------------------------------------------
@query(
    "notifiable_events",
    f"""{CHANGES_SQL} select convocatoria_id, tipo, titulo, estado from eventos join nuevas n using (fuente_id, identificador_externo) where es_relevante""",
)
def notifiable_events(spark, d):
    new, old, rules = _runs(spark, d)
    events = changes.detect_changes(new, old, rules)
    # a run's calls take the stored id before their events are looked up
    synced = mutate.upsert_calls(old, new, AS_OF)
    return outbox.notifiable_events(events, synced).select("convocatoria_id", "tipo", "titulo", "estado")


def _channels(spark, d) -> DataFrame:
    """Channel settings: a log, two chats (one not configured), two mail lists."""
    region = read(spark, d, "region")
    settings = (
        F.when(C("r_name") == "AFRICA", F.lit("{}"))
        .when(C("r_name") == "AMERICA", F.lit('{"token": "t", "chat_id": "42"}'))
        .when(C("r_name") == "ASIA", F.lit('{"token": "t"}'))
        .when(C("r_name") == "EUROPE", F.lit('{"host": "h", "target_emails": ["a@x.org", "b@x.org"]}'))
        .otherwise(F.lit('{"host": "h", "target_emails": []}'))
    )
    kind = F.when(C("r_name") == "AFRICA", "LOGGER").when(C("r_name").isin("AMERICA", "ASIA"), "TELEGRAM").otherwise("EMAIL")
    added = region.select(
        C("r_regionkey").alias("pos"), C("r_name").alias("nombre"), kind.alias("tipo"),
        settings.alias("configuracion"), F.lit(True).alias("activa"),
    )
    created = outbox.channel_configs(None, added, F.lit(AS_OF).cast("timestamp_ntz"))
    return created.join(added.select("nombre", "pos"), "nombre")


@query(
    "notification_fanout",
    f"""{CHANGES_SQL} select convocatoria_id, tipo, cast(r_regionkey as int) as pos,
        case when r_name = 'AFRICA' then 'LOGGER' when r_name in ('AMERICA', 'ASIA') then 'TELEGRAM' else 'EMAIL' end as canal,
        case r_name when 'AFRICA' then 'structlog' when 'AMERICA' then '42' when 'EUROPE' then 'a@x.org, b@x.org' else 'no_configurado' end as destinatario,
        case when es_relevante and r_name in ('AFRICA', 'AMERICA', 'EUROPE') then 'PENDIENTE' else 'SKIPPED' end as estado_envio,
        case when r_name = 'ASIA' then 'bot_token o chat_id no configurados' when r_name not in ('AFRICA', 'AMERICA', 'EUROPE')
        then 'host o target_emails no configurados' when not es_relevante then 'evento no relevante' end as error_log
        from eventos, region""",
)
def notification_fanout(spark, d):
    events = changes.detect_changes(*_runs(spark, d)).select("convocatoria_id", "tipo", "es_relevante")
    return outbox.notification_fanout(events, _channels(spark, d)).drop("es_relevante")


@query(
    "channel_configs",
    """select 'canal ' || s_name as nombre, 'EMAIL' as tipo, 'host' || s_nationkey as host, s_acctbal >= 0 as activa from supplier""",
)
def channel_configs(spark, d):
    added = read(spark, d, "supplier").select(
        F.concat(F.lit("canal "), "s_name").alias("nombre"),
        F.lit("EMAIL").alias("tipo"),
        F.to_json(F.struct(F.concat(F.lit("host"), C("s_nationkey").cast("string")).alias("host"))).alias("configuracion"),
        (C("s_acctbal") >= 0).alias("activa"),
    )
    rows = outbox.channel_configs(None, added, F.lit(AS_OF).cast("timestamp_ntz"))
    return rows.select("nombre", "tipo", F.try_variant_get("configuracion", "$.host", "string").alias("host"), "activa")


@query(
    "notification_result",
    f"""{cte('resultados')}, g as (select evento_id, coalesce(bool_or(estado = 'ENVIADO'), false) as s, coalesce(bool_or(estado = 'FALLIDO'), false) as f,
        max_by(error_log, pos) filter (estado = 'FALLIDO') as e, max_by(canal, pos) as c, max_by(destinatario, pos) as dd,
        max_by(estado, pos) as st, max_by(coalesce(error_log, '~'), pos) as el from resultados group by 1)
        select evento_id, case when s or f then 'COMPOSITE' else c end as canal, case when s or f then 'multiples' else dd end as destinatario,
        case when s then 'ENVIADO' when f then 'FALLIDO' else st end as estado,
        case when s and f then 'algunos canales fallaron: ' || e when f then e when s then null else nullif(el, '~') end as error_log from g""",
)
def notification_result(spark, d):
    return outbox.notification_result(view(spark, d, "resultados"))


@query(
    "persist_notifications",
    f"""{cte('resultados', 'historial')} select evento_id as historial_cambios_id, canal, destinatario, estado, error_log from resultados
        where evento_id in (select id from historial)""",
)
def persist_notifications(spark, d):
    rows = outbox.persist_notifications(
        view(spark, d, "resultados"), view(spark, d, "historial"), F.lit(AS_OF).cast("timestamp_ntz")
    )
    return rows.drop("id", "enviado_en")


@query(
    "render_messages",
    f"""{CHANGES_SQL}, m as (select d.*, string_agg('• <b>' || campo || ':</b> <strike>' || coalesce(nullif(anterior, ''), 'N/A') || '</strike> → ' || coalesce(nullif(nuevo, ''), 'N/A'), chr(10) order by n) over w as struck,
        string_agg(campo || ': ''' || coalesce(nullif(anterior, ''), 'None') || ''' -> ''' || coalesce(nullif(nuevo, ''), 'None') || '''', ', ' order by n) over w as quoted
        from deltas d window w as (partition by id)),
        md as (select id, any_value(struck) as struck, any_value(quoted) as quoted from m group by 1)
        select e.convocatoria_id, tipo || ' en ' || c_name as asunto,
        case when tipo = 'APERTURA' then '<b>🆕 NUEVA CONVOCATORIA</b>' || chr(10) || '🏛 <i>' || c_name || '</i>' || chr(10) || chr(10) || '<b>' || n.titulo || '</b>' || chr(10) || chr(10)
        || '💰 Monto: ' || coalesce('$' || replace(format('{{:,}}', cast(round_even(n.monto, 0) as bigint)), ',', '.'), 'No definido') || chr(10) || '📅 Cierre: ' || coalesce(strftime(n.fecha_cierre, '%d/%m/%Y'), 'No definido')
        else '<b>⚠️ CAMBIO DETECTADO</b>' || chr(10) || '🏛 <i>' || c_name || '</i>' || chr(10) || chr(10) || '<b>' || n.titulo || '</b>' || chr(10) || chr(10) || struck end
        || chr(10) || chr(10) || '🔗 <a href=''' || n.url_detalle || '''>Ver detalle en el portal</a>' as mensaje_chat,
        case when tipo = 'APERTURA' then 'NUEVA CONVOCATORIA en ' || c_name || chr(10) || 'Título: ' || n.titulo || chr(10) || 'Estado: ' || n.estado || chr(10) || 'URL: ' || n.url_detalle || chr(10)
        || 'Cierre: ' || coalesce(strftime(n.fecha_cierre, '%Y-%m-%d %H:%M:%S') || '+00:00', 'No definido')
        else 'CAMBIO RELEVANTE en ' || c_name || chr(10) || 'Título: ' || n.titulo || chr(10) || 'Cambios: ' || quoted || chr(10) || 'URL: ' || n.url_detalle end as mensaje_log
        from eventos e join nuevas n using (fuente_id, identificador_externo) join customer on c_custkey = fuente_id left join md on md.id = e.convocatoria_id""",
)
def render_messages(spark, d):
    new, old, rules = _runs(spark, d)
    events = changes.detect_changes(new, old, rules)
    calls = new.select(*changes.KEY, "titulo", "estado", "url_detalle", "monto", "fecha_cierre")
    rows = serving.with_source_name(events.join(calls, changes.KEY), view(spark, d, "fuentes"))
    return outbox.render_messages(rows).select("convocatoria_id", "asunto", "mensaje_chat", "mensaje_log")


# --- fallback chains ---------------------------------------------------------------
_OUTCOME_SQL = f"""{cte('intentos')}, g as (select fuente_id, run_id, min(step) filter (fetched and items > 0) as ok,
    min(step) filter (fetched and items = 0 and explicit_empty) as em, bool_or(fetched) as f, count(*) as pasos,
    count(*) filter (not fetched) as fallidos, sum(latency) as execution_time_seconds from intentos group by 1, 2),
    r as (select *, ok is not null and (em is null or ok < em) as win from g),
    s as (select r.*, (select min(items) from intentos i where i.fuente_id = r.fuente_id and i.run_id = r.run_id and step = ok and fetched and items > 0) as n from r)"""


@query(
    "step_metrics",
    f"""{_OUTCOME_SQL} select fuente_id, run_id, pasos, fallidos, execution_time_seconds, case when win then ok else em end as step,
        case when win then n else 0 end as total_items, case when win then 'SUCCESS' when em is not null then 'SUCCESS_EMPTY'
        when not f then 'FETCH_FAILED' else 'EXTRACTION_FAILED' end as final_status from s""",
)
def step_metrics(spark, d):
    return attempts.step_metrics(view(spark, d, "intentos"))


@query(
    "first_success",
    f"""{_OUTCOME_SQL} select i.fuente_id, i.run_id, i.step, i.items from intentos i join s on s.fuente_id = i.fuente_id
        and s.run_id = i.run_id and win and ok = i.step""",
)
def first_success(spark, d):
    tried = view(spark, d, "intentos")
    return attempts.first_success(tried, tried).select("fuente_id", "run_id", "step", "items")


# --- mutations --------------------------------------------------------------------
_OLD = "creado_en < cast('1998-06-01' as timestamp) - interval 180 day and estado <> 'ABIERTO'"


@query(
    "retention_purge",
    f"""{cte('convocatorias', 'historial', 'notificaciones')}, x as (select id from convocatorias where {_OLD}),
        h as (select id from historial where convocatoria_id not in (select id from x))
        select 'convocatorias' as tabla, id from convocatorias where id not in (select id from x)
        union all select 'historial_cambios', id from h
        union all select 'notificaciones', id from notificaciones where historial_cambios_id in (select id from h)
        union all select 'eliminadas', count(*) from x""",
)
def retention_purge(spark, d):
    kept = mutate.retention_purge(
        view(spark, d, "convocatorias"), view(spark, d, "historial"), view(spark, d, "notificaciones"), AS_OF
    )
    parts = [
        t.select(F.lit(name).alias("tabla"), C("eliminadas" if name == "eliminadas" else "id").cast("bigint").alias("id"))
        for name, t in kept.items()
    ]
    return mutate.union_items(*parts)


@query(
    "cascade_delete",
    f"""{cte('fuentes', 'capturas', 'convocatorias', 'historial', 'notificaciones', 'auditoria')}, x as (select id from fuentes where not activa),
        c as (select id from convocatorias where fuente_id in (select id from x)),
        h as (select id, snapshot_id from historial where convocatoria_id not in (select id from c))
        select 'fuentes' as tabla, id, cast(null as bigint) as fuente_id from fuentes where activa
        union all select 'snapshots', id, fuente_id from capturas where fuente_id not in (select id from x)
        union all select 'convocatorias', id, fuente_id from convocatorias where fuente_id not in (select id from x)
        union all select 'historial_cambios', id, null from h
        union all select 'notificaciones', id, null from notificaciones where historial_cambios_id in (select id from h)
        union all select 'audit_logs', id, case when fuente_id not in (select id from x) then fuente_id end from auditoria
        union all select 'bloqueos', count(*), null from h where snapshot_id in (select id from capturas where fuente_id in (select id from x))""",
)
def cascade_delete(spark, d):
    names = ("fuentes", "capturas", "convocatorias", "historial", "notificaciones", "auditoria")
    kept = mutate.delete_sources(*[view(spark, d, n) for n in names], ~C("activa"))
    parts = []
    for name, t in kept.items():
        source = C("fuente_id") if "fuente_id" in t.columns else F.lit(None)
        ident = C("bloqueos" if name == "bloqueos" else "id")
        parts.append(t.select(F.lit(name).alias("tabla"), ident.cast("bigint").alias("id"), source.cast("bigint").alias("fuente_id")))
    return mutate.union_items(*parts)


@query(
    "toggle_active",
    f"{cte('fuentes')} select id, case when estrategia = 'json_api' then not activa else activa end as activa from fuentes",
)
def toggle_active(spark, d):
    return mutate.toggle_active(view(spark, d, "fuentes"), C("estrategia") == "json_api").select("id", "activa")


@query(
    "union_items",
    """select 'orden' as origen, o_orderkey as id, o_orderpriority as titulo, cast(o_totalprice as double) as monto from orders
        union all select 'linea', l_orderkey, l_returnflag, null from lineitem""",
)
def union_items(spark, d):
    a = read(spark, d, "orders").select(
        F.lit("orden").alias("origen"), C("o_orderkey").alias("id"), C("o_orderpriority").alias("titulo"), C("o_totalprice").alias("monto")
    )
    b = read(spark, d, "lineitem").select(F.lit("linea").alias("origen"), C("l_orderkey").alias("id"), C("l_returnflag").alias("titulo"))
    return mutate.union_items(a, b)


@query(
    "sync_sources",
    """select coalesce(c_custkey::varchar, sha256(nombre)) as id, nombre, coalesce(n_url, 'https://old/' || c_custkey) as url_base,
        coalesce(n_config, 'old') as config, coalesce(c_acctbal >= 0, true) as activa,
        case when n_url is not null then cast('1998-06-01' as timestamp) else cast('1995-01-01' as timestamp) end as actualizado_en
        from (select coalesce(c_name, s) as nombre, * from customer full join (select replace(s_name, 'Supplier', 'Customer') as s,
        'https://new/' || s_suppkey as n_url, '{"a":' || s_nationkey || '}' as n_config from supplier
        union all select s_name, 'https://new/s' || s_suppkey, '{}' from supplier) on s = c_name)""",
)
def sync_sources(spark, d):
    """Half of the rule documents name stored sources, half are new."""
    stored = read(spark, d, "customer").select(
        C("c_custkey").cast("string").alias("id"), C("c_name").alias("nombre"),
        F.concat(F.lit("https://old/"), C("c_custkey").cast("string")).alias("url_base"), F.lit("old").alias("config"),
        (C("c_acctbal") >= 0).alias("activa"),
        F.lit("1995-01-01").cast("timestamp_ntz").alias("creado_en"), F.lit("1995-01-01").cast("timestamp_ntz").alias("actualizado_en"),
    )
    supplier = read(spark, d, "supplier")
    key = C("s_suppkey").cast("string")
    known = supplier.select(
        F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("nombre"),
        F.concat(F.lit("https://new/"), key).alias("url_base"),
        F.concat(F.lit('{"a":'), C("s_nationkey").cast("string"), F.lit("}")).alias("config"),
    )
    fresh = supplier.select(C("s_name").alias("nombre"), F.concat(F.lit("https://new/s"), key).alias("url_base"), F.lit("{}").alias("config"))
    return mutate.sync_sources(stored, known.unionByName(fresh), AS_OF).drop("creado_en")
