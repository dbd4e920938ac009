"""Point lookups over a written layout, and daily partials against the rows behind them."""

import datetime as dt

from pyspark.sql import functions as F

from atalaya.operators import rollups
from atalaya.sources import lookups

KEYS = ["fuente_id", "identificador_externo"]


def scanned(df):
    """Rows of a lookup, and files and rows that its scan read."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return rows, leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()


def test_a_lookup_reads_few_rows(spark, tmp_path):
    # even numbers only: odd ones lie between the least and the largest key of a row group
    calls = spark.range(0, 400_000, 2).selectExpr("id % 7 as fuente_id", "concat('C-', lpad(id, 8, '0')) as identificador_externo", "sha2(cast(id as string), 512) as titulo")
    path = str(tmp_path / "calls")
    lookups.write_lookup(calls, path, KEYS, buckets=4, group_bytes=1 << 20, file_rows=30_000)
    assert spark.read.parquet(path).count() == 200_000

    def find(*wanted):
        return scanned(lookups.lookup(spark, path, calls.schema, KEYS, *wanted, buckets=4))

    rows, files, read = find((4 % 7, "C-00000004"))
    assert [r.identificador_externo for r in rows] == ["C-00000004"] and rows[0].titulo
    assert files <= 2 and 0 < read <= 30_000
    assert rows[0].asDict().keys() == {"fuente_id", "identificador_externo", "titulo"}
    rows, _, read = find((1, "C-00100001"))
    assert rows == [] and read == 0
    rows, _, _ = find((4, "C-00000004"), (6, "C-00000006"), (0, None))
    assert sorted(r.identificador_externo for r in rows) == ["C-00000004", "C-00000006"]
    assert lookups.lookup(spark, path, calls.schema, KEYS, buckets=4).collect() == []


def test_lookup_of_awkward_tables(spark, tmp_path):
    schema = "fuente_id bigint, identificador_externo string, cubos int"
    rows = [(1, "a", 1), (1, "a", 1), (None, "a", 2), (1, None, 3), (1, "", 4)]
    for name, data, want in (("some", rows, 2), ("none", [], 0)):
        df = spark.createDataFrame(data, schema)
        lookups.write_lookup(df, str(tmp_path / name), KEYS, 4)
        find = lambda *k, df=df, name=name: lookups.lookup(spark, str(tmp_path / name), df.schema, KEYS, k, buckets=4).count()
        assert (find(1, "a"), find(1, ""), find(None, "a"), find(9, "z")) == (want, want // 2, 0, 0)


def test_partials_of_days(spark):
    at = lambda n, hour=0: dt.datetime(2026, 1, n, hour)
    rows = [("f", at(1), "a", 1), ("f", at(1, 23), "b", 2), ("f", at(2), "a", 3), ("g", at(3), "c", None), ("g", None, "d", 5), (None, at(9), None, 6)]
    df = spark.createDataFrame(rows, "fuente_id string, ts timestamp_ntz, hash string, valor int")
    made = lambda rows: rollups.daily_partials(rows, "ts", ["fuente_id"], {"n": None, "grandes": F.col("valor") > 1}, {"distintos": "hash"})
    whole = made(df)
    halves = rollups.merge_partials(made(df.where("valor < 3")), made(df.where("valor is null or valor >= 3")), ["fuente_id"])
    for partials in (whole, halves):
        over = lambda *a, partials=partials, **k: [tuple(r) for r in rollups.over_window(partials, *a, **k).collect()]
        assert over("2026-01-01", "2026-01-02") == [(3, 2, 2)]
        assert over(None, None) == [(5, 3, 3)] and over(None, None, undated=True) == [(6, 4, 4)]
        assert over("2027-01-01", None) == [(0, 0, 0)] and over("2027-01-01", None, ["fuente_id"]) == []
        assert sorted(over(None, "2026-01-03", ["fuente_id"])) == [("f", 3, 2, 2), ("g", 1, 0, 1)]
    assert [tuple(r) for r in rollups.over_window(made(df.limit(0)), None, None).collect()] == [(0, 0, 0)]
    many = spark.range(200_000).selectExpr("'f' as fuente_id", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(cast(id % 20 as int)) as ts", "cast(id % 50000 as string) as hash", "1 as valor")
    n, _, distinct = rollups.over_window(made(many), "2026-01-01", "2026-01-20").first()
    assert n == 200_000 and abs(distinct - 50_000) <= 3 * 50_000 * 1.04 / 2 ** (rollups.LG_K / 2)
