"""Streams whose state begins with stored rows, or that wait for what has not come yet."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from atalaya.sources import paging
from atalaya.streaming import captures as streams
from atalaya.streaming import pages
from atalaya.streaming.stored_changes import last_versions, stream_changes_stored

VERSION = "fuente_id string, identificador_externo string, fecha_captura timestamp_ntz, titulo string, estado string"


def day(n, hour=0):
    return dt.datetime(2026, 1, n, hour)


def run(stream, out, checkpoint):
    done = (
        stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/lote={n}"))
        .outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    done.awaitTermination()


def changes_of(spark, out):
    rows = spark.read.parquet(out).orderBy("identificador_externo", "fecha_captura").collect()
    return [(r.identificador_externo, r.convocatoria_id if r.identificador_externo in ("s", None) else "", r.tipo, r.fecha_captura.day,
             [(d.campo, d.valor_anterior, d.valor_nuevo) for d in r.deltas]) for r in rows]


def test_stored_calls_late_versions_and_a_restart(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    stored = spark.createDataFrame(
        [("f", "s", day(1), "S", "ABIERTO", "id-s"), ("f", "s", None, "viejo", "ABIERTO", "id-s"), ("f", "q", day(1), "Q", None, "id-q"),
         (None, None, day(1), "N", "ABIERTO", "id-n")], VERSION + ", id string",
    )

    def land(*rows, known=stored):
        spark.createDataFrame(list(rows), VERSION).coalesce(1).write.mode("append").parquet(src)
        stream = streams.landed_stream(spark, src, spark.createDataFrame([], VERSION).schema)
        run(stream_changes_stored(stream, known, ["titulo", "estado"], delay="2 days"), out, ck)

    # the stored call is known to the first batch; day 6 comes before day 5
    land(("f", "s", day(2), "S", "CERRADO"), ("f", "a", day(6), "A2", None), ("f", "s", day(2), "S", "CERRADO"), (None, None, day(3), "N2", "ABIERTO"))
    land(("f", "a", day(5), "A", None), ("f", "s", None, "sin hora", None), ("f", "q", day(5), "Q", None))
    land(("f", "s", day(9), "S9", "CERRADO"), ("f", "a", day(1), "tarde", None))
    land(("f", "s", day(20), "S20", "CERRADO"), known=stored.limit(0))
    assert changes_of(spark, out) == [
        (None, "id-n", "MODIFICACION", 3, [("titulo", "N", "N2")]),
        ("a", "", "APERTURA", 5, []),
        ("a", "", "MODIFICACION", 6, [("titulo", "A", "A2")]),
        ("s", "id-s", "MODIFICACION", 2, [("estado", "ABIERTO", "CERRADO")]),
        ("s", "id-s", "MODIFICACION", 9, [("titulo", "S", "S9")]),
    ]
    state = {r.identificador_externo: (r.titulo, r.estado, r.fecha_captura.day) for r in last_versions(spark, ck).collect()}
    assert state == {"s": ("S9", "CERRADO", 9), "a": ("A2", None, 6), "q": ("Q", None, 5), None: ("N2", "ABIERTO", 3)}
    assert [(r.identificador_externo, r.titulo) for r in last_versions(spark, ck, waiting=True).collect()] == [("s", "S20")]

    # another stream begins where this one is
    src2, out2 = str(tmp_path / "in2"), str(tmp_path / "out2")
    rows = [("f", "s", day(21), "S9", "ABIERTO"), ("f", "b", day(21), "B", None), ("f", "z", day(28), "Z", None)]
    spark.createDataFrame(rows, VERSION).write.parquet(src2)
    stream = streams.landed_stream(spark, src2, spark.createDataFrame([], VERSION).schema)
    run(stream_changes_stored(stream, last_versions(spark, ck), ["titulo", "estado"], delay="1 day"), out2, str(tmp_path / "ck2"))
    assert changes_of(spark, out2) == [("b", "", "APERTURA", 21, []), ("s", "id-s", "MODIFICACION", 21, [("estado", "CERRADO", "ABIERTO")])]


def test_state_leaves_after_the_retention(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    none = spark.createDataFrame([], VERSION + ", id string")
    for rows in ([("f", "a", day(1), "A", None)], [("f", "b", day(9), "B", None)], [("f", "a", day(20), "A", None)], [("f", "b", day(30), "B", None)]):
        spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("append").parquet(src)
        stream = streams.landed_stream(spark, src, none.drop("id").schema)
        run(stream_changes_stored(stream, none, ["titulo", "estado"], delay="0 seconds", retention_days=5), out, ck)
    found = spark.read.parquet(out).groupBy("identificador_externo").agg(F.count("*").alias("n")).collect()
    assert {r.identificador_externo: r.n for r in found} == {"a": 2, "b": 2}


PAGE = "fuente_id string, run_id string, page int, n_items int, total_pages int, found int, html string, fecha_captura timestamp_ntz"
RULES = {
    "short": (lambda: pages.short_pages(20), lambda df, most: paging.consolidate_pages_short(df, 20, most)),
    "total": (pages.declared_total, paging.consolidate_pages_total),
    "found": (pages.found_count, paging.consolidate_pages_found),
}


@pytest.mark.parametrize(("kind", "most"), [("short", None), ("total", None), ("found", None), ("short", 3)])
def test_pages_in_any_order(spark, tmp_path, kind, most):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def p(run, page, items=20, total=None, found=None, html="x", on=1):
        return ("f", run, page, items, total, found, html, day(on))

    lots = [
        [p("a", 2), p("a", 1, total=3, found=25), p("b", 3), p("c", 1, 5, 1, 4, on=2), p(None, 1, 20, 2), p("g", 2), p("h", 1, None, 4, 30, "")],
        [p("a", 4, on=2), p("b", 1, 20, 9, 0, on=2), p("c", 2, on=2), p("d", 1, 0, 7, 100, on=2), p("e", None), p("a", 2, on=2), p("g", 4, 3, on=2)],
        [p("a", 3, 7, on=2), p("b", 4, 0, html="", on=2), p("b", 5, on=2), p("d", 2, on=2), p("a", 5, on=2), p("z", 1, 1, 1, 1, "x", 20), p("z", 3, 20, on=20)],
    ]
    early = None
    for lot in lots:
        spark.createDataFrame(lot, PAGE).coalesce(1).write.mode("append").parquet(src)
        stream = streams.landed_stream(spark, src, spark.createDataFrame([], PAGE).schema)
        run(pages.stream_pages(stream, RULES[kind][0](), most, "1 day", 24), out, ck)
        early = early or sorted((r.run_id, r.page) for r in spark.read.parquet(out).collect() if r.run_id)
    got = [(r.run_id, r.page) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got))  # each page once, over restarts
    every = spark.createDataFrame([r for lot in lots for r in lot], PAGE)
    want = {(r.run_id, r.page) for r in RULES[kind][1](every.where("page is not null and coalesce(run_id, '') <> 'z'"), most).collect()}
    assert {x for x in got if x[0] not in ("z", None)} == want
    assert (None, 1) in got and ("z", 1) in got and ("z", 3) not in got
    assert ("b", 3) not in early and (("a", 2) in early)
