"""Exclusion lists by trigram index against trying every pattern on every row; counts taken while writing."""

import pytest
from pyspark.sql import functions as F

from atalaya.operators import observed
from atalaya.operators.filters import exclude_patterns
from atalaya.operators.pattern_index import exclude_by_index

ITEMS = "fuente_id string, titulo string, url_detalle string, pos int"
RULES = "fuente_id string, excluir_patrones_titulo array<string>, excluir_patrones_url array<string>"
TITLES = ["Fondo Único 2026", "FONDO ÚNICO", "fondo unico", "Bases: capital semilla", "capitaal  semilla", "tİa maría", "STRASSE ẞ larga", "straße ß larga", "ΟΔΟΣ", "οδος uno", "", "ab", None, "x y\nz fondo"]
PATTERNS = ["fondo único", "capita+l.+semilla", "^ab$", "tia", "ẞ larga", "οδοσ", "fondo$", "(beca|fondo) u", "x.y", "a", "SEMILLA$", "\\bz\\b", "strasse"]


@pytest.mark.parametrize("lists", [[p] for p in PATTERNS] + [PATTERNS, [], None])
def test_index_equals_every_pattern(spark, lists):
    rows = [("f", t, u, i) for i, (t, u) in enumerate((t, u) for t in TITLES for u in ("https://e.org/A/Doc.pdf", None))]
    items = spark.createDataFrame([*rows, rows[0], ("g", "fondo único", "u", 99), (None, "fondo único", "u", 98)], ITEMS)
    rules = spark.createDataFrame([("f", lists, ["/a/DOC"] if lists == PATTERNS[:1] else None), ("h", ["x"], [""])], RULES)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(exclude_by_index(items, rules)) == order(exclude_patterns(items, rules))
    assert exclude_by_index(items.limit(0), rules).collect() == []


def test_many_patterns_without_a_nested_loop(spark, tmp_path):
    items = spark.range(3000).select(F.lit("f").alias("fuente_id"), F.concat(F.lit("convocatoria numero "), (F.col("id") * 97).cast("string"), F.lit(" fin")).alias("titulo"),
                                     F.lit(None).cast("string").alias("url_detalle"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda n: F.concat(F.lit("NUMERO "), n.cast("string"), F.lit(" ")))
    rules = spark.range(1).select(F.lit("f").alias("fuente_id"), numbers.alias("excluir_patrones_titulo"), F.array(F.lit("zzz")).alias("excluir_patrones_url"))
    for name, df in (("items", items), ("rules", rules)):  # as tables, since joins of constants are folded
        df.write.parquet(str(tmp_path / name))
    kept = exclude_by_index(*(spark.read.parquet(str(tmp_path / name)) for name in ("items", "rules")))
    plan = kept._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert kept.count() == sum(n * 97 > 99_999 for n in range(3000))


def test_counts_of_one_write(spark, tmp_path):
    rows = [(1, None), (2, "normalizacion"), (3, "vigencia"), (4, "vigencia"), (5, "otra"), (6, None)]
    path = str(tmp_path / "items")
    items = spark.createDataFrame(rows, "id int, motivo string")
    seen = spark.sparkContext.accumulator(0)
    once = items.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(items.schema)
    counts = observed.write_observed(once, path)
    assert seen.value == len(rows)  # read once
    assert counts == {"leidas": 6, "nuevas_encontradas": 2, "descartadas_normalizacion": 1, "descartadas_relevancia": 0, "descartadas_vigencia": 2, "descartadas_otras": 1}
    assert sorted((r.id, r.motivo) for r in spark.read.parquet(path).collect()) == rows
    assert set(observed.write_observed(items.limit(0), str(tmp_path / "none")).values()) == {0}


def test_lists_named_by_many_sources(spark):
    items = spark.createDataFrame([(s, t, "https://e.org/a.PDF", i) for i, (s, t) in enumerate((s, t) for s in ("f", "g", "h", None) for t in TITLES)], ITEMS)
    lists = spark.createDataFrame([("l", ["FONDO ÚNICO", "^ab$", None], None), ("m", ["semilla"], ["/A.pdf"]), ("n", [], [])], "lista string, " + RULES.partition(", ")[2])
    rules = spark.createDataFrame([("f", ["larga"], None, ["l", None]), ("g", None, [], ["l", "n"]), ("g", None, None, ["m"]), (None, ["a"], None, ["l"])], RULES + ", listas array<string>")
    kept = sorted(r.pos for r in exclude_by_index(items, rules, lists).collect())
    named = {"f": (["FONDO ÚNICO", "^ab$", "larga"], []), "g": (["FONDO ÚNICO", "^ab$", "semilla"], ["/A.pdf"])}
    plain = spark.createDataFrame([(s, *x) for s, x in named.items()], RULES)
    assert kept == sorted(r.pos for r in exclude_patterns(items, plain).collect())
