"""A run normalizes each item once; what depends on a source's rule alone is computed once a source."""

from pyspark.sql import functions as F

from atalaya.functions.text import rule_extract
from atalaya.operators.normalize import normalize_items
from atalaya.plans.monitor import run_stages

NOW = "2026-06-02"


def _tables(spark):
    text = "fuente_id string, identificador string, titulo string, descripcion string, url_detalle string, estado string, fecha_cierre string, monto string, pos int"
    items = spark.createDataFrame(
        [
            ("a", "1", "Fondo uno", None, "/1", "Abierto", "Fin: 31/12/2026", "$1.000,50", 1),
            ("a", "1", "Fondo uno", "nueva", "/1", "Abierto", "Fin: 30/12/2026", "$2.000", 2),
            ("a", "2", "Fondo dos", None, "/2", "", "pronto", None, 3),
            ("a", None, "Fondo tres", None, "/3", None, "Fin: 01/07/2026", "nada", 4),
            ("a", None, "Fondo tres", None, "/3", None, "Fin: 01/07/2026", "nada", 4),
            ("b", "1", "Licitación pública", None, "https://b.cl/1", "publish", "3 de julio de 2026", None, 5),
            ("b", "2", "Fondo cuatro", None, "https://b.cl/2", "Cerrado", None, "", 6),
            (None, "3", "Fondo cinco", None, "https://b.cl/3", "Abierto", "2026-08-01", None, 7),
        ],
        text,
    )
    rules = spark.createDataFrame(
        [("a", "https://a.cl/", r"Fin:\s*(\d{2}/\d{2}/\d{4})", "%d/%m/%Y", r"\$([\d.,]+)", True, True, "Maule"), ("b", "https://b.cl", None, None, None, False, False, None)],
        "fuente_id string, url_base string, fecha_regex string, fecha_formato string, monto_regex string, monto_normaliza boolean, fecha_normaliza boolean, region_defecto string",
    )
    return items, rules


def test_items_of_a_run_are_normalized_once(spark, tmp_path):
    items, rules = _tables(spark)
    plain = run_stages(items, rules, NOW, ["pos"])
    once = run_stages(items, rules, NOW, ["pos"], items_path=str(tmp_path / "items"))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "parquet" in plan
    rows = [sorted(map(str, x.collect())) for x in (once, plain)]
    assert rows[0] == rows[1] and len(rows[0]) == 7
    assert spark.read.parquet(str(tmp_path / "items")).count() == items.count()


def test_rule_parts_are_computed_once_a_source(spark):
    items, rules = _tables(spark)
    read = normalize_items(items, rules, NOW)
    items_side, rules_side = read._jdf.queryExecution().analyzed().toString().split("Join LeftOuter")
    assert "_date_pattern" in items_side and "regexp_replace(fecha_regex" not in items_side
    assert "regexp_replace(fecha_regex" in rules_side
    got = {(r.fuente_id, r.identificador_externo, r.pos): (str(r.fecha_cierre), str(r.monto), r.reject_reason) for r in read.collect()}
    assert got[("a", "1", 2)] == ("2026-12-30 00:00:00", "2000.00", None)
    assert got[("a", "2", 3)][2] == "fecha_invalida" and got[("b", "1", 5)][0] == "2026-07-03 00:00:00"
    assert got[(None, "3", 7)] == ("2026-08-01 00:00:00", "None", None)


def test_rule_extract_without_compiling_a_pattern_twice(spark):
    rows = spark.createDataFrame(
        [("a 12 b", r"(\d+)"), ("a 12 b", r"\d+"), ("a b", r"\d+"), ("ab", r"a(x)?b"), (None, "x"), ("t", None), ("", "x*")], "t string, p string"
    )
    found = rule_extract(F.col("t"), F.col("p"))
    assert [r.r for r in rows.select(found.alias("r")).collect()] == ["12", "12", None, "", None, "t", ""]
    assert "RLIKE(t" not in rows.select(found)._jdf.queryExecution().analyzed().toString()
