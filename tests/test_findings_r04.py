"""A run keeps little on disk beside its rows: no shuffle to deal a large table, no hashes on the way, nothing left over."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from atalaya.operators import observed
from atalaya.plans import state, tables
from atalaya.plans.monitor import monitor_run, run_stages
from atalaya.session import shared_folder, small_splits, working_folder

SPLIT = "spark.sql.files.maxPartitionBytes"
NOW = "2026-06-02"


def _files(folder):
    return [f"{at}/{name}" for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet")]


def _codecs(folder):
    files = _files(folder)
    return {c for (c,) in duckdb.execute("select distinct compression from parquet_metadata(?)", [files]).fetchall()}


def _items(spark):
    """Keys repeat, ``pos`` tells their rows apart; some rows lack a key or a URL."""
    return spark.range(400).select(
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("fuente_id"),
        F.when(F.col("id") % 9 != 0, (F.col("id") % 70).cast("string")).alias("identificador"),
        F.concat(F.lit("Fondo "), F.col("id").cast("string")).alias("titulo"),
        F.lit(None).cast("string").alias("descripcion"),
        F.when(F.col("id") % 11 != 0, F.lit("/x")).alias("url_detalle"),
        F.lit("Abierto").alias("estado"),
        F.when(F.col("id") % 7 == 0, "1 de enero de 2020").otherwise("31/12/2026").alias("fecha_cierre"),
        F.lit("").alias("monto"),
        F.col("id").alias("pos"),
    )


def _rules(spark):
    return spark.createDataFrame(
        [(f"s{i}", f"https://s{i}.cl/", None, None, None, False, False, None) for i in range(3)],
        "fuente_id string, url_base string, fecha_regex string, fecha_formato string, monto_regex string, monto_normaliza boolean, fecha_normaliza boolean, region_defecto string",
    )


def test_ids_are_made_after_files_and_shuffles(spark, tmp_path):
    items, rules = _items(spark), _rules(spark)
    path = str(tmp_path / "items")
    stages = run_stages(items, rules, NOW, ["pos"], items_path=path)
    assert "id" not in spark.read.parquet(path).columns and stages.columns[0] == "id"
    plan = stages._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan[plan.index("Window") :].split("Relation")[0]
    want = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in ("fuente_id", "identificador_externo")]), 256)
    assert stages.where(~F.col("id").eqNullSafe(want)).count() == 0
    rows = stages.collect()
    bad = [r for r in rows if r.motivo == "normalizacion"]
    good = {(r.fuente_id, r.identificador_externo): r.pos for r in rows if r.motivo != "normalizacion"}
    given = items.collect()
    stay = [r for r in given if r.identificador is not None and r.url_detalle is not None and r.pos % 7 != 0]
    assert len(bad) == len(given) - len(stay) and len(rows) == len(bad) + len(good)
    assert good == {k: max(r.pos for r in stay if (r.fuente_id, r.identificador) == k) for k in {(r.fuente_id, r.identificador) for r in stay}}


def test_files_of_a_run_are_compressed_well(spark, tmp_path):
    items, rules = _items(spark), _rules(spark)
    paths = {name: str(tmp_path / name) for name in ("items", "stages", "run")}
    nothing = run_stages(items, rules, NOW, ["pos"]).drop("motivo", "reject_reason").limit(0)
    stored = nothing.withColumns({name: F.lit(None).cast("timestamp_ntz") for name in ("creado_en", "actualizado_en")})
    alerts = rules.select("fuente_id", F.array(F.lit("estado")).alias("campos_sensibles"), F.array().cast("array<string>").alias("ignorar_cambios_en"))
    run = monitor_run(items, rules, alerts, stored, NOW, ["pos"], stages_path=paths["stages"], items_path=paths["items"])
    counts = observed.write_observed(run.stages, paths["run"])
    assert [_codecs(p) for p in paths.values()] == [{"ZSTD"}] * 3
    summary = run.summary().first().asDict()
    assert counts["leidas"] == summary["leidas"] == spark.read.parquet(paths["run"]).count()
    assert {k: v for k, v in counts.items() if k in summary}.items() <= summary.items()


def _table(path, groups, size):
    duckdb.execute(f"copy (select range as k, md5(range::varchar) || md5((range + 1)::varchar) as t from range({groups * size})) to '{path}' (format parquet, row_group_size {size})")
    return str(path)


def test_a_scan_with_work_for_all_cores_is_not_shuffled(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    path = _table(tmp_path / "t.parquet", 20, 61_440)
    with small_splits(spark, "512k"):
        rows = spark.read.parquet(path)
        spark.conf.set("spark.sql.files.openCostInBytes", "262144")
        try:
            left = tables.spread_items(rows)
            held = [r["count"] for r in left.groupBy(F.spark_partition_id()).count().collect()]
            assert left is rows and len(held) >= cores and sum(held) == 20 * 61_440
            monkeypatch.setattr(tables, "ITEMS_A_TASK", 5_000)  # row groups that are too large for a task
            dealt = tables.spread_items(rows)
            assert dealt is not rows and dealt.rdd.getNumPartitions() == -(-20 * 61_440 // 5_000)
            assert max(dealt.rdd.glom().map(len).collect()) <= 5_001
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
    few = spark.read.parquet(_table(tmp_path / "u.parquet", 1, 50))
    assert tables.spread_items(few).rdd.getNumPartitions() == cores
    assert tables.spread_items(few.limit(0)).count() == 0


def test_settings_and_folders_are_as_before(spark):
    given = spark.conf.get(SPLIT)
    kept = []
    with pytest.raises(ZeroDivisionError), small_splits(spark), working_folder(spark, "items") as path:
        assert spark.conf.get(SPLIT) == "8m"
        spark.range(3).write.parquet(path)
        kept.append(path)
        assert _files(path)
        raise ZeroDivisionError
    assert spark.conf.get(SPLIT) == given and not os.path.exists(kept[0])
    with working_folder(spark, "none"):  # nothing was written
        pass


@pytest.mark.parametrize("name,left", [("run_counts_observed", ["run"]), ("run_summary", ["stages"])])
def test_items_on_the_way_are_deleted(spark, monkeypatch, name, left):
    made = []

    def noted(session, purpose):
        made.append((purpose, shared_folder(session, purpose)))
        return made[-1][1]

    monkeypatch.setattr(state, "shared_folder", noted)
    monkeypatch.setattr("atalaya.session.shared_folder", noted)
    given = spark.conf.get(SPLIT)
    row = getattr(state, name)(spark, "/root/testdata/sf0.001").first()
    assert row.leidas > row.nuevas_encontradas > 0 and spark.conf.get(SPLIT) == given
    assert [purpose for purpose, path in made if os.path.exists(path)] == left and len(made) == 2
