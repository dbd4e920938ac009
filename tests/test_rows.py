"""Scalar rules and row filters, on the cases the behaviour is known for."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from atalaya.functions import amounts, dates, status, text, urls
from atalaya.operators import filters, normalize

C = F.col


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    rows = df.select("i", expression(C("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_dates(spark):
    good = [
        "15 de agosto de 2026", "15 de ago de 2026", "15/08/2026", "15-08-2026", "2026-08-15",
        "Postulaciones hasta el 15 de agosto de 2026", " 15 de AGOSTO de2026 ", "2026-08-15T10:00:00",
    ]
    assert values(spark, good, dates.parse_date_es) == [dt.datetime(2026, 8, 15)] * len(good)
    bad = ["", None, "no es una fecha", "32 de enero de 2026", "15 de xyz de 2026", "31/02/2026",
           "2026-13-01", "agosto 15, 2026", "x 15/08/2026", "1-2-0000"]
    assert values(spark, bad, dates.parse_date_es) == [None] * len(bad)


def test_dates_by_format(spark):
    rows = spark.createDataFrame(
        [("31/12/2026", "%d/%m/%Y"), ("1 de Marzo de 2026", "%d de %B de %Y"), ("99/99/9999", "%d/%m/%Y"),
         ("2026-01-02 03:04:05", "%Y-%m-%d %H:%M:%S"), ("x", "%d/%m/%Y")],
        "t string, f string",
    )
    got = [r.r for r in rows.select(dates.parse_date_fmt(C("t"), C("f")).alias("r")).collect()]
    assert got == [dt.datetime(2026, 12, 31), dt.datetime(2026, 3, 1), None, dt.datetime(2026, 1, 2, 3, 4, 5), None]


def test_short_months_and_reserved_letters(spark):
    rows = spark.createDataFrame([("15 aug 2026", "%d %b %Y"), ("15 Mar 2026", "%d %b %Y"), ("1#2#2026", "%d#%m#%Y"), ("5 o'clock", "%d o'clock")], "t string, f string")
    got = [r.r for r in rows.select(dates.parse_date_fmt(C("t"), C("f")).alias("r")).collect()]
    assert got[:3] == [dt.datetime(2026, 8, 15), dt.datetime(2026, 3, 15), dt.datetime(2026, 2, 1)]


def test_free_text(spark):
    found = values(
        spark,
        ["hasta el 3 de mayo", "Cierre: 7 de junio", "el 1 de mayo de 2026 o 02/03/2026", "nada"],
        dates.find_date,
    )
    assert found == ["3 de mayo", "7 de junio", "1 de mayo de 2026", None]
    assert values(spark, ["hasta $1.500 CLP", "son 25 UF", "Máximo: 300"], amounts.find_amount) == [
        "$1.500 CLP", "25 UF", "300",
    ]


def test_amounts(spark):
    got = values(spark, ["15.000.000", "1.234,56", " 7 ", "Muchos millones", "$5"], amounts.parse_amount)
    assert got == [Decimal("15000000.00"), Decimal("1234.56"), Decimal("7.00"), None, None]
    assert values(spark, [Decimal("1234567.50"), None], amounts.amount_text, "decimal(15,2)") == [
        "$1.234.568", "No definido",
    ]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("publish", "ABIERTO"), ("draft", "DESCONOCIDO"), ("Abierta", "ABIERTO"), ("Cerrado", "CERRADO"),
        ("ABRIR BARRA DE HERRAMIENTAS", "DESCONOCIDO"), (None, "DESCONOCIDO"), ("  ", "DESCONOCIDO"),
        ("finalizado", "FINALIZADO"), ("Proximamente", "PROXIMAMENTE"), ("Muy próximamente aquí", "PROXIMAMENTE"),
        ("Abierto y cerrado", "ABIERTO"), ("POSTULA", "ABIERTO"), ("Vigente hoy", "ABIERTO"),
        ("trash", "CERRADO"), ("Suspendida", "SUSPENDIDO"), ("ABIERTOS", "DESCONOCIDO"),
    ],
)
def test_status(spark, raw, expected):
    assert values(spark, [raw], status.normalize_status) == [expected]


def test_status_not_strict(spark):
    loose = lambda c: status.normalize_status(c, strict=False)
    assert values(spark, ["Viene proximamente"], status.normalize_status) == ["DESCONOCIDO"]
    assert values(spark, ["Viene proximamente"], loose) == ["PROXIMAMENTE"]


def test_relevance(spark):
    dropped = [
        "Licitación Pública N° 123", "Compra de Equipo de Cómputo", "Viático Comisión Servicio",
        "Resolución Exenta N° 456 Adjudica", "Acta de Recepción de Ofertas",
        "Declaración Jurada de Intereses", "Formato Tipo de Recibo de Pago", "CÓDIGO DE ÉTICA",
    ]
    kept = ["Fondo de Innovación 2026", "Programa de Apoyo Regional", "", None]
    assert values(spark, dropped + kept, filters.is_excluded_title) == [True] * 8 + [False] * 4


def test_funding_signals(spark):
    signal = lambda c: filters.has_funding_signal(c, F.lit(None).cast("string"))
    titles = ["concurso id", "Proyecto de iid", "concurso i+d", "proyecto i+d", "concurso de ideas", "proyecto vial"]
    assert values(spark, titles, signal) == [True, True, True, True, False, False]


def test_title_years(spark):
    recent = lambda c: filters.title_year_is_recent(c, "2026-06-02 12:00:00")
    assert values(spark, ["Fondo 2026", "Fondo 2024", "Fondo", "2026 y 2019", "N° 20231"], recent) == [
        True, False, True, False, True,
    ]


def test_liveness(spark):
    now = "2026-06-02 12:00:00"
    at = lambda days: dt.datetime(2026, 6, 2, 12) + dt.timedelta(days=days)
    rows = [
        ("CERRADA", at(30)), ("ADJUDICADA", None), ("SUSPENDIDA", at(5)), ("DESCONOCIDO", at(30)),
        ("DESCONOCIDO", at(-30)), ("ABIERTO", at(-30)), ("ABIERTO", at(-120)), (None, None), ("ABIERTO", at(-150)),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, estado string, fecha_cierre timestamp_ntz")

    def live(months):
        return [r.i for r in filters.filter_live(df, now, months).orderBy("i").collect()]

    assert live(3) == [3, 5, 7]
    assert live(0) == [3, 5, 6, 7, 8]
    assert live(6) == [3, 5, 6, 7, 8]


def test_normalize(spark):
    items = spark.createDataFrame(
        [
            (1, "F001", "Fondo Semilla", "/fondos/F001", "ABIERTO", "Cierre: 31/12/2026", "Monto máximo: $15.000.000"),
            (1, "F002", "Sin url", None, "ABIERTO", None, None),
            (1, "F002B", "Sin estado", "https://x.cl/a", None, None, None),
            (1, "F003", "Otra fecha", "/a", "ABIERTO", "Termina el 31-12-2026", None),
            (1, "F004", "Mala fecha", "/a", "ABIERTO", "Cierre: 99/99/9999", None),
            (1, "F005", "Mal monto", "/a", "ABIERTO", None, "Muchos millones"),
            (1, "F006", "Vencida", "/a", "ABIERTO", "Cierre: 01/01/2026", None),
            (1, "F007", "Se abre", "/a", "", "Cierre: 01/01/2027", None),
            (1, "", "Sin id", "/a", "ABIERTO", None, None),
        ],
        "fuente_id int, identificador string, titulo string, url_detalle string, estado string, fecha_cierre string, monto string",
    ).withColumn("descripcion", F.lit(None).cast("string"))
    rules = spark.createDataFrame(
        [(1, "https://ejemplo.com/", True, r"(\d{2}/\d{2}/\d{4})", "%d/%m/%Y", True, r"\$([\d.]+)", "Biobío")],
        "fuente_id int, url_base string, fecha_normaliza boolean, fecha_regex string, fecha_formato string, "
        "monto_normaliza boolean, monto_regex string, region_defecto string",
    )
    rows = {r.identificador_externo: r for r in normalize.normalize_items(items, rules, "2026-06-02").collect()}
    assert {k: r.reject_reason for k, r in rows.items()} == {
        "F001": None, "F002": "sin_url", "F002B": None, "F003": "fecha_invalida", "F004": "fecha_invalida",
        "F005": "monto_invalido", "F006": "expirada", "F007": None, "": "sin_identificador",
    }
    good = rows["F001"]
    assert (good.url_detalle, good.fecha_cierre, good.monto, good.region) == (
        "https://ejemplo.com/fondos/F001", dt.datetime(2026, 12, 31), Decimal("15000000.00"), "Biobío",
    )
    assert rows["F002B"].estado == "DESCONOCIDO" and rows["F007"].estado == "ABIERTO"
    # rows whose extractor applied the patterns already are not matched again
    done = items.withColumn("regex_aplicada", F.lit(True)).withColumn("fecha_cierre", F.lit("31/12/2026")).withColumn("monto", F.lit("15.000"))
    again = normalize.normalize_calls(done, rules, "2026-06-02").where("identificador_externo = 'F001'").first()
    assert again.fecha_cierre == dt.datetime(2026, 12, 31) and again.monto == Decimal("15000.00")


@pytest.mark.parametrize(
    ("href", "expected"),
    [
        ("/a/b", "https://x.cl/a/b"), ("c", "https://x.cl/d/c"), ("../z?q=1", "https://x.cl/z?q=1"),
        ("https://y.cl/q", "https://y.cl/q"), ("//y.cl/q", "https://y.cl/q"), ("?p=2", "https://x.cl/d/e?p=2"),
        ("#f", "https://x.cl/d/e?k=1#f"), ("./a/./b/../c", "https://x.cl/d/a/c"), ("mailto:a@b", "mailto:a@b"),
        ("..", "https://x.cl/"), ("../../../g", "https://x.cl/g"),
    ],
)
def test_urls(spark, href, expected):
    base = F.lit("https://x.cl/d/e?k=1")
    assert values(spark, [href], lambda c: urls.resolve_url(c, base)) == [expected]


def test_query_parameters(spark):
    got = values(
        spark,
        ["https://a.cl/x?pagina=1&cantidad=5#f", "https://a.cl/x", "https://a.cl/x?b=&pagina=9&pagina=8"],
        lambda c: urls.set_query_param(c, "pagina", F.lit(3)),
    )
    assert got == ["https://a.cl/x?pagina=3&cantidad=5#f", "https://a.cl/x?pagina=3", "https://a.cl/x?b=&pagina=3"]


def test_strict_json(spark):
    texts = ['{"a":1}', "[1] x", '{"a":1}}', "1}] x", "1]} x", "1,2", '1,"v":2', "", "null", " [1] "]
    ok = values(spark, texts, lambda c: text.strict_json(c).isNotNull())
    assert ok == [True, False, False, False, False, False, False, False, True, True]
    assert values(spark, ['{"a":1}'], lambda c: F.try_variant_get(text.strict_json(c), "$.a", "int")) == [1]


def test_a_value_in_many_branches_is_computed_once(spark):
    from atalaya.functions.dates import parse_date_es, parse_date_fmt
    from atalaya.functions.status import normalize_status

    rows = spark.createDataFrame([(" 3 de mayo de 2026 ", "%d/%m/%Y"), ("4-5-2026", "%d-%m-%Y"), (None, None)], "t string, f string")
    for column in (normalize_status(F.col("t")), parse_date_es(F.col("t")), parse_date_fmt(F.col("t"), F.col("f"))):
        plan = rows.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("btrim(") + plan.count("trim(BOTH") == 1
    found = rows.select(parse_date_es(F.col("t")).cast("string"), parse_date_fmt(F.col("t"), F.col("f")).cast("string")).collect()
    assert [tuple(r) for r in found] == [("2026-05-03 00:00:00", None), ("2026-05-04 00:00:00", "2026-05-04 00:00:00"), (None, None)]
