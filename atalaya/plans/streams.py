"""Streaming queries: each runs over what has landed and reads its result back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from atalaya.operators.changes import KEY
from atalaya.plans.registry import query
from atalaya.plans.tables import VIEWS, cte, read
from atalaya.session import several_states, shared_folder
from atalaya.streaming import captures as streams
from atalaya.streaming import changes, pages, stored_changes

C = F.col


def _landed(spark, d, table: str):
    schema = read(spark, d, table).schema
    return streams.landed_stream(spark, d, schema, glob=f"{table}.parquet")


def _captures(spark, d):
    return _landed(spark, d, "events").select(
        C("user_id").alias("fuente_id"), C("ts").alias("fecha_captura"), C("props").alias("contenido_crudo")
    )


def _finish(running) -> None:
    """A stream that failed raises here."""
    running.awaitTermination()


@query(
    "stream_ingest",
    f"{cte('capturas')} select fuente_id, fecha_captura, sha256(contenido_crudo) as hash_contenido from capturas",
)
def stream_ingest(spark, d):
    out = shared_folder(spark, "ingest")
    _finish(streams.stream_ingest(_captures(spark, d), f"{out}/datos", f"{out}/control"))
    return spark.read.parquet(f"{out}/datos").select("fuente_id", "fecha_captura", "hash_contenido")


@query(
    "stream_dedupe",
    f"{cte('capturas')} select distinct fuente_id, sha256(contenido_crudo) as hash_contenido from capturas",
)
def stream_dedupe(spark, d):
    out = shared_folder(spark, "dedupe")
    hashed = _captures(spark, d).withColumn("hash_contenido", F.sha2("contenido_crudo", 256))
    unique = streams.repeats_dropped(hashed, delay="366 days")
    _finish(streams.run_to_parquet(unique, f"{out}/datos", f"{out}/control"))
    return spark.read.parquet(f"{out}/datos").select("fuente_id", "hash_contenido")


@query(
    "stream_counts",
    f"""{cte('capturas')} select time_bucket(interval '12 hours', fecha_captura, cast('1970-01-01' as timestamp)) as ventana, fuente_id, count(*) as n
        from capturas group by 1, 2""",
)
def stream_counts(spark, d):
    out = shared_folder(spark, "counts")
    counts = streams.window_counts(_captures(spark, d))
    _finish(streams.run_updates(counts, f"{out}/datos", f"{out}/control"))
    return streams.latest_counts(spark, f"{out}/datos")


FIELDS = ["titulo", "estado", "monto"]


@query(
    "stream_changes",
    """with v as (select user_id, event_type as titulo, case when value < 20 then 'ABIERTO' else 'CERRADO' end as estado, ts from events),
        x as (select *, lag(titulo) over w as t, lag(estado) over w as e, row_number() over w as n from v window w as (partition by user_id order by ts))
        select cast(user_id as varchar) as identificador_externo, case when n = 1 then 'APERTURA' else 'MODIFICACION' end as tipo, ts as fecha_captura,
        case when n = 1 then '' else concat_ws(',', case when t <> titulo then 'titulo' end, case when e <> estado then 'estado' end) end as campos
        from x where n = 1 or t <> titulo or e <> estado""",
)
def stream_changes(spark, d):
    """Versions of one call per user; the state keeps the last of each."""
    out = shared_folder(spark, "changes")
    versions = _landed(spark, d, "events").select(
        F.lit("portal").alias(KEY[0]),
        C("user_id").cast("string").alias(KEY[1]),
        C("ts").alias("fecha_captura"),
        C("event_type").alias("titulo"),
        F.when(C("value") < 20, "ABIERTO").otherwise("CERRADO").alias("estado"),
        F.lit(None).cast("decimal(15,2)").alias("monto"),
    )
    events = changes.stream_changes(versions, FIELDS)
    _finish(
        events.writeStream.foreachBatch(
            lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/datos/lote={n}")
        )
        .outputMode("update")
        .option("checkpointLocation", f"{out}/control")
        .trigger(availableNow=True)
        .start()
    )
    fields = F.array_join(F.transform("deltas", lambda x: x.campo), ",")
    return spark.read.parquet(f"{out}/datos").select(
        KEY[1], "tipo", "fecha_captura", fields.alias("campos")
    )


def _landed_in_lots(rows, ready, out: str, lots: int) -> None:
    """Rows as files that come one after the other, by when each is ready (seconds)."""
    low, high = rows.agg(F.min(ready), F.max(ready)).first()
    if low is None:
        rows.write.parquet(f"{out}/0")
        return
    lot = F.least(F.floor((ready - low) * lots / (high - low + 1)), F.lit(lots - 1))
    for number in range(lots):
        rows.where(lot == number).coalesce(1).write.parquet(f"{out}/{number}")


#: Stored calls are the last versions before this time; the stream brings the versions from then on.
STORED_UNTIL = "2024-01-10 00:00:00"


@query(
    "stream_changes_initial",
    f"""with v as (select user_id, event_id, event_type as titulo, case when value < 20 then 'ABIERTO' else 'CERRADO' end as estado, ts from events),
        x as (select *, lag(titulo) over w as t, lag(estado) over w as e, row_number() over w as n,
        max(case when ts < timestamp '{STORED_UNTIL}' then event_id end) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) is not null as conocida
        from v window w as (partition by user_id order by ts))
        select cast(user_id as varchar) as identificador_externo, case when n = 1 then 'APERTURA' else 'MODIFICACION' end as tipo, ts as fecha_captura,
        case when n = 1 then '' else concat_ws(',', case when t <> titulo then 'titulo' end, case when e <> estado then 'estado' end) end as campos,
        conocida from x where (n = 1 or t <> titulo or e <> estado) and ts >= timestamp '{STORED_UNTIL}'
        and epoch_ms(ts) <= (select epoch_ms(max(ts)) from events) - 86400000""",
)
def stream_changes_initial(spark, d):
    """Versions come up to twenty hours late in four lots, a trigger each; the state begins as the stored calls and waits for a day."""
    out = shared_folder(spark, "initial")
    versions = read(spark, d, "events").select(
        F.lit("portal").alias(KEY[0]),
        C("user_id").cast("string").alias(KEY[1]),
        C("ts").alias("fecha_captura"),
        C("event_type").alias("titulo"),
        F.when(C("value") < 20, "ABIERTO").otherwise("CERRADO").alias("estado"),
        F.concat(F.lit("guardada-"), C("user_id").cast("string")).alias("id"),
    )
    cut = F.lit(STORED_UNTIL).cast("timestamp_ntz")
    stored = versions.where(C("fecha_captura") < cut).groupBy(*KEY).agg(
        *[F.max_by(c, "fecha_captura").alias(c) for c in ("titulo", "estado", "id")], F.max("fecha_captura").alias("fecha_captura")
    )
    new = versions.where(C("fecha_captura") >= cut).drop("id")
    seconds = F.unix_timestamp(C("fecha_captura").cast("timestamp"))
    _landed_in_lots(new, seconds + F.pmod(F.xxhash64(*KEY, "fecha_captura"), F.lit(20)) * 3600, f"{out}/llegadas", 4)
    landed = streams.landed_stream(spark, f"{out}/llegadas/*", new.schema, max_files=1)
    events = stored_changes.stream_changes_stored(landed, stored, FIELDS[:2], delay="1 day")
    with several_states(spark):
        running = (
            events.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/datos/lote={n}"))
            .outputMode("append")
            .option("checkpointLocation", f"{out}/control")
            .trigger(availableNow=True)
            .start()
        )
    _finish(running)
    fields = F.array_join(F.transform("deltas", lambda x: x.campo), ",")
    known = C("convocatoria_id").startswith("guardada-")
    return spark.read.parquet(f"{out}/datos").select(KEY[1], "tipo", "fecha_captura", fields.alias("campos"), known.alias("conocida"))


_STOPS = {
    "short": "coalesce(least(min(page) filter (n_items < 20), min(page - 1) filter (n_items is null)), max(page))",
    "total": "least(greatest(coalesce(max(total_pages) filter (page = 1), 1), 1), min(page) filter (n_items = 0))",
    "found": "coalesce(least(case when max(found) filter (page = 1) > 0 then cast(ceil((max(found) filter (page = 1)) / 10.0) as int) end, min(page) filter (html = '') - 1), max(page))",
}
_DAY_MS = 86_400_000


def _stream_pages(name: str, rule):
    """Pages up to twenty hours late in four lots, a trigger each; of several copies of a page one lands."""
    sql = f"""{cte('paginas').replace(' from lineitem', ", timestamp '2020-01-01 00:00:00' + to_hours(cast(l_orderkey % 9600 + l_linenumber * 7 % 20 as int)) as fecha_captura, "
        "row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity) as copia from lineitem")},
        unicas as (select *, row_number() over (partition by fuente_id order by page) = page as seguida from paginas where copia = 1),
        x as (select fuente_id, {_STOPS[name]} as u, epoch_ms(max(fecha_captura)) + {_DAY_MS} <= (select epoch_ms(max(fecha_captura)) from unicas) - {_DAY_MS} as cerrada
        from unicas group by 1) select cast(fuente_id as varchar) as fuente_id, cast(page as bigint) as page from unicas join x using (fuente_id) where page <= u and (seguida or cerrada)"""

    @query(f"stream_pages_{name}", sql)
    def run(spark, d):
        out = shared_folder(spark, "pages")
        lines = read(spark, d, "lineitem")
        copy = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        hours = C("l_orderkey") % 9600 + C("l_linenumber") * 7 % 20
        shaped = [F.expr(e).alias(c) for c, e in VIEWS["paginas"][1].items()]
        when = F.timestamp_seconds(F.lit(1_577_836_800) + hours * 3600).cast("timestamp_ntz").alias("fecha_captura")
        once = lines.withColumn("copia", F.row_number().over(copy)).where("copia = 1").select(*shaped, when)
        late = F.pmod(F.xxhash64("run_id", "page"), F.lit(20)) * 3600
        _landed_in_lots(once, F.unix_timestamp(C("fecha_captura").cast("timestamp")) + late, f"{out}/llegadas", 4)
        landed = streams.landed_stream(spark, f"{out}/llegadas/*", once.schema, max_files=1)
        kept = pages.stream_pages(landed, rule(), delay="1 day", quiet_hours=24)
        with several_states(spark):
            running = streams.run_to_parquet(kept, f"{out}/datos", f"{out}/control")
        _finish(running)
        return spark.read.parquet(f"{out}/datos").select("fuente_id", "page")

    return run


_stream_pages("short", lambda: pages.short_pages(20))
_stream_pages("total", pages.declared_total)
_stream_pages("found", pages.found_count)
