"""The engine's tables as views over the given star-schema tables.

Each view is a list of SQL expressions that Spark and DuckDB read alike, so
the query and its check start from the same rows. ``{ts}`` stands for the
wall-clock timestamp type of the engine at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-01 00:00:00"

_MONTH_NAMES = (
    "case month(l_shipdate) when 1 then 'enero' when 2 then 'febrero' when 3 then 'marzo' "
    "when 4 then 'abril' when 5 then 'mayo' when 6 then 'junio' when 7 then 'julio' "
    "when 8 then 'agosto' when 9 then 'septiembre' when 10 then 'octubre' "
    "when 11 then 'noviembre' else 'diciembre' end"
)
_D = "cast(day(l_shipdate) as string)"
_DD = "lpad(cast(day(l_shipdate) as string), 2, '0')"
_MM = "lpad(cast(month(l_shipdate) as string), 2, '0')"
_Y = "cast(year(l_shipdate) as string)"

_TITLE = (
    "case o_orderpriority "
    "when '1-URGENT' then 'Licitación pública N° ' || cast(o_orderkey as string) "
    "when '2-HIGH' then 'Fondo concursable ' || cast(year(o_orderdate) as string) "
    "when '3-MEDIUM' then 'Compra de equipo menor ' || cast(o_orderkey as string) "
    "when '4-NOT SPECIFIED' then 'Programa de apoyo ' || cast(o_orderkey as string) "
    "else 'Concurso ' || cast(year(o_orderdate) as string) || ' y ' || "
    "cast(year(o_orderdate) + 1 as string) end"
)
_CALL = {
    "id": "o_orderkey",
    "fuente_id": "o_custkey",
    "identificador_externo": "'C-' || cast(o_orderkey as string)",
    "titulo": _TITLE,
    "descripcion": "case when o_orderpriority <> '4-NOT SPECIFIED' then 'Prioridad ' || o_orderpriority end",
    "url_detalle": "'https://portal.example.org/c/' || cast(o_orderkey as string)",
    "fecha_apertura": "o_orderdate - interval 60 day",
    "fecha_cierre": "case when o_orderpriority <> '5-LOW' or o_orderstatus <> 'P' then o_orderdate end",
    "monto": "case when o_orderpriority <> '2-HIGH' or o_orderstatus <> 'O' then cast(o_totalprice as decimal(15,2)) end",
    "region": "case o_orderpriority when '1-URGENT' then 'Metropolitana' when '2-HIGH' then 'Nacional' when '3-MEDIUM' then 'Valparaíso' end",
    "estado": "case o_orderstatus when 'O' then 'ABIERTO' when 'F' then 'CERRADO' else 'PROXIMAMENTE' end",
    "creado_en": "o_orderdate - interval 90 day",
    "actualizado_en": "o_orderdate - interval 30 day",
}
_NEW_CALL = _CALL | {
    "id": "o_orderkey + 1000000000",
    "titulo": f"case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' then ({_TITLE}) || ' (segundo llamado)' else ({_TITLE}) end",
    "descripcion": "case when o_orderstatus = 'P' then 'Bases actualizadas' when o_orderpriority <> '4-NOT SPECIFIED' then 'Prioridad ' || o_orderpriority end",
    "fecha_cierre": "case when o_orderpriority = '1-URGENT' and o_orderstatus = 'O' then o_orderdate + interval 15 day when o_orderpriority <> '5-LOW' or o_orderstatus <> 'P' then o_orderdate end",
    "monto": "case when o_orderpriority = '1-URGENT' then cast(cast(o_totalprice as decimal(15,2)) + 1000.00 as decimal(15,2)) when o_orderpriority <> '2-HIGH' or o_orderstatus <> 'O' then cast(o_totalprice as decimal(15,2)) end",
    "estado": "case when o_orderpriority = '2-HIGH' or o_orderstatus = 'P' then 'PROXIMAMENTE' when o_orderstatus = 'O' then 'ABIERTO' else 'CERRADO' end",
}
_SENSITIVE = (
    "case c_mktsegment when 'BUILDING' then 'estado,fecha_cierre' when 'MACHINERY' then 'monto' "
    "when 'FURNITURE' then 'titulo,monto' when 'AUTOMOBILE' then 'estado' else '' end"
)
_IGNORED = (
    "case c_mktsegment when 'BUILDING' then 'descripcion' when 'FURNITURE' then 'monto' "
    "when 'AUTOMOBILE' then 'titulo' else '' end"
)

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    # sources of listings
    "fuentes": (
        "customer",
        {
            "id": "c_custkey",
            "nombre": "c_name",
            "url_base": "'https://s' || cast(c_custkey as string) || '.example.org/'",
            "estrategia": "case c_mktsegment when 'BUILDING' then 'html_static' when 'MACHINERY' then 'json_api' when 'FURNITURE' then 'rss_feed' when 'AUTOMOBILE' then 'wp_ajax' end",
            "activa": "c_acctbal >= 0",
            "region_defecto": "case when c_acctbal > 5000 then 'Nacional' end",
            "creado_en": "cast('1995-01-01' as {ts})",
            "actualizado_en": "cast('1995-01-01' as {ts})",
        },
    ),
    "alertas": (
        "customer",
        {"fuente_id": "c_custkey", "sensibles": _SENSITIVE, "ignorados": _IGNORED},
    ),
    # all calls, the stored ones, and those of a new run
    "convocatorias": ("orders", _CALL),
    "guardadas": ("orders where o_orderdate < cast('2000-01-01' as {ts})", _CALL),
    "nuevas": ("orders where o_orderdate >= cast('1995-07-01' as {ts})", _NEW_CALL),
    # raw item rows; equal ids appear more than once
    "items": (
        "lineitem",
        {
            "fuente_id": "l_suppkey",
            "identificador": "case when l_quantity > 1 then 'L' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) end",
            "titulo": "case l_returnflag when 'A' then 'Concurso de innovación ' || " + _Y + " when 'N' then 'Acta de apertura ' || cast(l_orderkey as string) else 'Programa de fomento ' || cast(l_partkey as string) end",
            "descripcion": "case when l_tax > 0 then 'Línea ' || cast(l_linenumber as string) end",
            "url_detalle": "case when l_discount > 0.09 then null when l_linestatus = 'O' then '/fondos/' || cast(l_orderkey as string) else 'https://otro.example.org/' || cast(l_partkey as string) end",
            "estado": "case l_returnflag || l_linestatus when 'AO' then 'Concurso abierto' when 'AF' then 'Cerrado por plazo' when 'NO' then 'publish' when 'NF' then 'Adjudicada' when 'RO' then '' else 'trash' end",
            "fecha_cierre": f"case l_linenumber when 1 then {_D} || ' de ' || ({_MONTH_NAMES}) || ' de ' || {_Y} when 2 then {_DD} || '/' || {_MM} || '/' || {_Y} when 3 then {_DD} || '-' || {_MM} || '-' || {_Y} when 4 then {_Y} || '-' || {_MM} || '-' || {_DD} || 'T23:59:59' when 5 then 'Postulaciones hasta el ' || {_DD} || ' de ' || upper({_MONTH_NAMES}) || ' de ' || {_Y} when 6 then '32 de enero de ' || {_Y} else 'sin fecha' end",
            "monto": "'Monto máximo: $' || cast(cast(l_quantity as int) as string) || '.' || lpad(cast(l_partkey as string), 6, '0') || ',50'",
            "region": "case when l_linestatus = 'F' then 'Maule' end",
            "cierre": "l_shipdate",
            "linea": "l_linenumber",
            "parte": "l_partkey",
            "precio": "l_extendedprice",
        },
    ),
    # captures, attempts and logs
    "capturas": (
        "events",
        {
            "id": "event_id",
            "fuente_id": "user_id",
            "fecha_captura": "ts",
            "contenido_crudo": "props",
        },
    ),
    "intentos": (
        "events",
        {
            "fuente_id": "user_id",
            "run_id": "cast(cast(ts as date) as string)",
            "step": "hour(ts)",
            "fetched": "event_type <> 'error'",
            "items": "case when event_type = 'view' then 0 when event_type <> 'click' then cast(floor(value) as int) end",
            "explicit_empty": "value < 10",
            "latency": "value",
        },
    ),
    "historial": (
        "events",
        {
            "id": "event_id",
            "convocatoria_id": "user_id",
            "snapshot_id": "event_id",
            "fecha_deteccion": "ts",
            "es_apertura": "event_type = 'signup'",
            "delta": "case when event_type = 'signup' then '[]' when event_type = 'view' then '[{\"campo\":\"estado\",\"valor_nuevo\":\"CERRADO\"},{\"valor_anterior\":\"1\"}]' else '[{\"campo\":\"monto\",\"valor_anterior\":null,\"valor_nuevo\":\"' || cast(value as string) || '\"}]' end",
            "es_relevante": "event_type in ('signup', 'purchase')",
        },
    ),
    "resultados": (
        "events",
        {
            "evento_id": "user_id * 100 + day(ts)",
            "pos": "event_id",
            "canal": "case when event_type in ('signup', 'error') then 'EMAIL' else 'TELEGRAM' end",
            "destinatario": "'d' || cast(user_id as string)",
            "estado": "case when event_type in ('signup', 'purchase') then 'ENVIADO' when event_type = 'error' then 'FALLIDO' else 'SKIPPED' end",
            "error_log": "case when event_type = 'error' then 'error ' || cast(event_id as string) when event_type = 'view' then 'evento no relevante' end",
        },
    ),
    "notificaciones": (
        "events",
        {
            "id": "event_id",
            "historial_cambios_id": "event_id",
            "canal": "case when event_type in ('signup', 'error') then 'EMAIL' else 'TELEGRAM' end",
            "destinatario": "'d' || cast(user_id as string)",
            "enviado_en": "ts",
            "estado": "case when event_type = 'error' then 'FALLIDO' else 'ENVIADO' end",
            "error_log": "case when event_type = 'error' then props end",
        },
    ),
    "auditoria": (
        "events",
        {
            "id": "event_id",
            "fuente_id": "case when event_type <> 'view' then user_id end",
            "nivel": "case when event_type = 'error' then 'ERROR' when event_type = 'view' then 'INFO' else 'WARNING' end",
            "modulo": "event_type",
            "mensaje": "props",
            "creado_en": "ts",
        },
    ),
    # landed result pages of paged listings
    "paginas": (
        "lineitem",
        {
            "fuente_id": "l_orderkey",
            "run_id": "'r' || cast(l_orderkey as string)",
            "page": "l_linenumber",
            "n_items": "case when l_discount < 0.01 then null when l_tax > 0.07 then 0 else cast(floor(l_quantity) as int) end",
            "total_pages": "case when l_returnflag <> 'A' then cast(floor(l_quantity / 10) as int) end",
            "found": "cast(floor(l_quantity) as int)",
            "html": "case when l_tax > 0.07 then '' else '<i>' || cast(l_partkey as string) || '</i>' end",
        },
    ),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows whose bodies one task parses at most.
ROWS_A_TASK = 25_000


def spread(rows: DataFrame) -> DataFrame:
    """Slim rows over all cores, in tasks of a bounded number of rows, before bodies are parsed.

    Parsing costs far more than reading, so a table in fewer files than there are cores would leave most of them idle,
    and a few large row groups would be a few long tasks. A table with enough partitions is left as it is: nothing is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-rows.count() // ROWS_A_TASK))
    return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted)


#: Items are short rows: a task takes this many where they are dealt, a scan's own task may hold eight times as many.
ITEMS_A_TASK = 250_000


def spread_items(rows: DataFrame) -> DataFrame:
    """``spread`` for rows without bodies: a scan with rows for all cores and no task too large is left as it is.

    Splits smaller than a row group hold no rows, so the tasks that have some are counted.
    """
    held = [found["count"] for found in rows.groupBy(F.spark_partition_id()).count().collect()]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(held) >= cores and max(held) <= 8 * ITEMS_A_TASK:
        return rows
    return rows.repartition(max(cores, -(-sum(held) // ITEMS_A_TASK)))


def view(spark: SparkSession, sf_dir: str, name: str, wide: bool = False, by: Callable = spread) -> DataFrame:
    """An engine table as a Spark DataFrame; ``wide`` spreads it over all cores."""
    source, columns = VIEWS[name]
    table, _, condition = source.partition(" where ")
    rows = read(spark, sf_dir, table)
    if wide:
        rows = by(rows)
    if condition:
        rows = rows.where(condition.format(ts="timestamp_ntz"))
    return rows.selectExpr(
        *[f"{sql.format(ts='timestamp_ntz') if '{ts}' in sql else sql} as {c}" for c, sql in columns.items()]
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rules with their field lists as arrays."""
    return view(spark, sf_dir, "alertas").select(
        "fuente_id",
        F.split("sensibles", ",").alias("campos_sensibles"),
        F.split("ignorados", ",").alias("ignorar_cambios_en"),
    )


def cte(*names: str) -> str:
    """The same tables as a WITH clause for the SQL check."""
    parts = []
    for name in names:
        source, columns = VIEWS[name]
        listed = ", ".join(
            f"{sql.format(ts='timestamp') if '{ts}' in sql else sql} as {c}" for c, sql in columns.items()
        )
        parts.append(f"{name} as (select {listed} from {source.format(ts='timestamp')})")
    return "with " + ", ".join(parts)
