"""Changes, mutations, notifications, fallback chains and streams."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from atalaya.operators import attempts, changes, dedupe, mutate, outbox, serving
from atalaya.plans.tables import alerts, view
from atalaya.sources import sinks
from atalaya.streaming import captures as streams
from atalaya.streaming.changes import stream_changes, with_relevance

C = F.col
SF = "/root/testdata/sf0.001"
CALL = (
    "id string, fuente_id string, identificador_externo string, titulo string, descripcion string, url_detalle string, "
    "fecha_apertura timestamp_ntz, fecha_cierre timestamp_ntz, monto decimal(15,2), region string, estado string, "
    "creado_en timestamp_ntz, actualizado_en timestamp_ntz"
)
NOW = "2026-06-02 12:00:00"


def call(key, id=None, titulo="T", descripcion=None, estado="ABIERTO", cierre=None, monto=None):
    at = dt.datetime(2026, 1, 1)
    return (id or f"n-{key}", "f", key, titulo, descripcion, "https://x/", None, cierre, monto, None, estado, at, at)


def rules(spark, sensitive=(), ignored=()):
    return spark.createDataFrame([("f", list(sensitive), list(ignored))], "fuente_id string, campos_sensibles array<string>, ignorar_cambios_en array<string>")


def events(spark, new, old, **lists):
    found = changes.detect_changes(spark.createDataFrame(new, CALL), spark.createDataFrame(old, CALL), rules(spark, **lists))
    return {r.identificador_externo: (r.tipo, [d.campo for d in r.deltas], r.es_relevante, r.convocatoria_id) for r in found.collect()}


def test_changes(spark):
    old = [call("M1", "o1"), call("M2", "o2"), call("M4", "o4", cierre=dt.datetime(2026, 6, 30)), call("M5", "o5", monto=Decimal("5.00")), call("GONE", "o6")]
    new = [call("M1", estado="CERRADO"), call("M2", descripcion="nueva"), call("M3"), call("M4", cierre=dt.datetime(2026, 7, 1)), call("M5", monto=Decimal("5.00"))]
    assert events(spark, new, old, sensitive=["estado"], ignored=["descripcion"]) == {
        "M1": ("MODIFICACION", ["estado"], True, "o1"),
        "M3": ("APERTURA", [], True, "n-M3"),
        "M4": ("MODIFICACION", ["fecha_cierre"], False, "o4"),
    }
    assert events(spark, new, old, sensitive=["descripcion"], ignored=["descripcion"])["M1"][2] is False
    assert events(spark, new, new) == {}


def test_delta_values_and_history(spark):
    new = [call("A", cierre=dt.datetime(2026, 7, 1), monto=Decimal("2.50"))]
    found = changes.detect_changes(spark.createDataFrame(new, CALL), spark.createDataFrame([call("A", "o")], CALL), rules(spark))
    log = changes.event_log(found, F.lit("s1"), F.lit(NOW).cast("timestamp_ntz"))
    back = changes.read_deltas(log).first()
    assert [tuple(d) for d in back.deltas] == [("fecha_cierre", None, "2026-07-01 00:00:00+00:00"), ("monto", None, "2.50")]
    assert back.tipo == "MODIFICACION" and '"valor_anterior":null' in log.first().delta


def test_upsert_is_idempotent_and_quiets_the_next_run(spark):
    stored, new = view(spark, SF, "guardadas"), view(spark, SF, "nuevas")
    once = mutate.upsert_calls(stored, new, NOW)
    twice = mutate.upsert_calls(once, new, NOW)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    assert changes.detect_changes(new, once, alerts(spark, SF)).isEmpty()
    assert once.select("id").distinct().count() == once.count()


def test_upsert_keeps_identity(spark):
    row = mutate.upsert_calls(spark.createDataFrame([call("A", "o")], CALL), spark.createDataFrame([call("A", titulo="N")], CALL), NOW).first()
    assert (row.id, row.titulo, row.creado_en, row.actualizado_en) == ("o", "N", dt.datetime(2026, 1, 1), dt.datetime(2026, 6, 2, 12))


def test_upsert_carries_metadata(spark):
    old = spark.createDataFrame([call("A", "o"), call("B", "p")], CALL)
    new = spark.createDataFrame([call("A", titulo="N")], CALL)
    tagged = lambda t, v: t.withColumn("metadatos", F.parse_json(F.lit(v)))
    value = F.to_json("metadatos").alias("m")
    read = lambda t: {r.identificador_externo: r.m for r in t.select("identificador_externo", value).collect()}
    assert read(mutate.upsert_calls(tagged(old, '{"v":1}'), tagged(new, '{"v":2}'), NOW)) == {"A": '{"v":2}', "B": '{"v":1}'}
    assert read(mutate.upsert_calls(tagged(old, '{"v":1}'), new, NOW)) == {"A": '{"v":1}', "B": '{"v":1}'}


def test_versions_on_disk(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.publish_version(spark.range(3), root, 1)
    sinks.publish_version(sinks.read_version(spark, root, 1).where("id > 0"), root, 2)
    assert sinks.read_version(spark, root, 1).count() == 3 and sinks.read_version(spark, root, 2).count() == 2


def test_report_file(spark, tmp_path):
    lines = spark.createDataFrame([("B", "b"), ("A", "a")], "fuente string, linea string")
    sinks.write_report(lines, str(tmp_path / "r"), ["# t", ""])
    parts = sorted((tmp_path / "r").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == ["# t", "", "a", "b"]


def test_hot_groups_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((C("id") % 2).alias("k"), C("id").alias("pos"))
    plan = dedupe.dedupe_last(rows, ["k"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r.pos for r in dedupe.dedupe_last(rows, ["k"], ["pos"]).collect()} == {998, 999}


def test_call_detail_of_hot_call(spark):
    calls = spark.createDataFrame([call("A", "a"), call("B", "b")], CALL)
    history = spark.createDataFrame([(str(i), "a", i == 0, "[]", True, dt.datetime(2026, 1, 1 + i)) for i in range(5)],
                                    "id string, convocatoria_id string, es_apertura boolean, delta string, es_relevante boolean, fecha_deteccion timestamp_ntz")
    none = spark.createDataFrame([], "id string, nombre string")
    rows = serving.call_detail(calls, none, history).collect()
    assert sorted((r.id, r.evento_id) for r in rows if r.evento_id) == [("a", str(i)) for i in range(5)]
    assert [r.id for r in rows if not r.evento_id] == ["b"] and rows[0].fuente_nombre == "Desconocido"
    one = serving.call_detail(calls, none, history, C("id") == "b").collect()
    assert [(r.id, r.tipo) for r in one] == [("b", None)]


def test_name_filter_rules(spark):
    calls = spark.createDataFrame([call("A", "a")], CALL)
    sources = spark.createDataFrame([("f", "Uno%"), ("g", "Dos")], "id string, nombre string")
    count = lambda **k: serving.select_calls(calls, sources, **k).count()
    assert count(fuente_nombre="uno") == 1 and count(fuente_nombre="n_%") == 0 and count(fuente_nombre="o%") == 1
    assert count(fuente_id="f", fuente_nombre="dos") == 1 and count(fuente_id="f", fuente_nombre="nadie") == 0


def test_notification_results(spark):
    rows = [(1, 0, "LOGGER", "x", "ENVIADO", None), (1, 1, "EMAIL", "x", "FALLIDO", "boom"), (2, 0, "EMAIL", "x", "FALLIDO", "a"), (2, 1, "TELEGRAM", "x", "FALLIDO", "b"),
            (3, 0, "TELEGRAM", "no_configurado", "SKIPPED", "sin"), (4, None, None, None, None, None), (5, 0, "LOGGER", "x", "ENVIADO", None)]
    tried = spark.createDataFrame(rows, "evento_id int, pos int, canal string, destinatario string, estado string, error_log string")
    got = {r.evento_id: (r.canal, r.estado, r.error_log) for r in outbox.notification_result(tried).collect()}
    assert got == {1: ("COMPOSITE", "ENVIADO", "algunos canales fallaron: boom"), 2: ("COMPOSITE", "FALLIDO", "b"), 3: ("TELEGRAM", "SKIPPED", "sin"),
                   4: ("COMPOSITE", "SKIPPED", "no hay adaptadores registrados"), 5: ("COMPOSITE", "ENVIADO", None)}


def test_fallback_chain(spark):
    rows = [("a", 0, False, None, False), ("a", 1, True, 0, False), ("a", 2, True, 4, False), ("b", 0, True, 0, True), ("b", 1, True, 3, False),
            ("c", 0, False, None, False), ("d", 0, True, None, False), ("e", 0, True, 2, False), ("e", 1, True, 9, False)]
    tried = spark.createDataFrame([("f", *r) for r in rows], "fuente_id string, run_id string, step int, fetched boolean, items int, explicit_empty boolean")
    got = {r.run_id: (r.step, r.total_items, r.final_status) for r in attempts.run_outcomes(tried).collect()}
    assert got == {"a": (2, 4, "SUCCESS"), "b": (0, 0, "SUCCESS_EMPTY"), "c": (None, 0, "FETCH_FAILED"), "d": (None, 0, "EXTRACTION_FAILED"), "e": (0, 2, "SUCCESS")}


def test_content_changed_across_buckets(spark):
    rows = [(i, "f", dt.datetime(2026, 1, 1 + i // 2, i % 2), h) for i, h in enumerate("aabbba")]
    caps = spark.createDataFrame(rows, "id int, fuente_id string, fecha_captura timestamp_ntz, hash_contenido string")
    assert [r.cambio for r in dedupe.content_changed(caps).orderBy("id").collect()] == [True, False, True, False, False, True]


def test_stream_changes_over_batches(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "fuente_id string, identificador_externo string, fecha_captura timestamp_ntz, titulo string, estado string"
    day = lambda n: dt.datetime(2026, 1, n)

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = streams.landed_stream(spark, str(src), spark.read.schema(schema).parquet(str(src)).schema)
        found = with_relevance(stream_changes(stream, ["titulo", "estado"]), rules(spark, ["estado"]))
        done = (
            found.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/lote={n}"))
            .outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        done.awaitTermination()

    land(("f", "a", day(2), "A", "ABIERTO"), ("f", "b", day(2), "B", "ABIERTO"))
    land(("f", "a", day(4), "A", "CERRADO"), ("f", "a", day(3), "A2", "ABIERTO"), ("f", "b", day(1), "viejo", "ABIERTO"))
    land(("f", "b", day(5), "B", "ABIERTO"), ("f", "a", day(6), "A3", "CERRADO"))
    rows = spark.read.parquet(str(out)).orderBy("identificador_externo", "fecha_captura").collect()
    assert [(r.identificador_externo, r.tipo, r.fecha_captura.day, [d.campo for d in r.deltas], r.es_relevante) for r in rows] == [
        ("a", "APERTURA", 2, [], True), ("a", "MODIFICACION", 3, ["titulo"], False), ("a", "MODIFICACION", 4, ["titulo", "estado"], True),
        ("a", "MODIFICACION", 6, ["titulo"], False), ("b", "APERTURA", 2, [], True),
    ]


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    body = spark.createDataFrame([("f", dt.datetime(2026, 1, 1), "x")], "fuente_id string, fecha_captura timestamp_ntz, contenido_crudo string")
    for _ in range(2):
        body.write.mode("append").parquet(src)
        streams.stream_ingest(streams.landed_stream(spark, src, body.schema), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
