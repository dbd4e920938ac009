"""The bucketed store: what a change touches, and what a lost or refused one leaves."""

import pytest
from pyspark.sql import functions as F

from atalaya.sources import store as stores

SCHEMAS = {
    "fuentes": "id long, activa boolean",
    "snapshots": "id long, fuente_id long",
    "convocatorias": "id long, fuente_id long, estado string",
    "historial_cambios": "id long, convocatoria_id long, snapshot_id long",
    "notificaciones": "id long, historial_cambios_id long",
    "audit_logs": "id long, fuente_id long",
}
ROWS = {
    "fuentes": [(1, True), (2, False), (3, False)],
    "snapshots": [(10 * f + i, f) for f in (1, 2, 3) for i in range(3)],
    "convocatorias": [(100 * f + i, f, "ABIERTO" if i else "CERRADO") for f in (1, 2, 3) for i in range(5)],
    # an event of a call of source 1 points to a capture of source 2; source 3 is free to go
    "historial_cambios": [(1000 * f + i, 100 * f + i, 20 if (f, i) == (1, 0) else 10 * f) for f in (1, 2, 3) for i in range(5)],
    "notificaciones": [(10_000 * f + i, 1000 * f + i % 5) for f in (1, 2, 3) for i in range(8)],
    "audit_logs": [(7, 1), (8, 3), (9, None)],
}


def filled(spark, tmp_path, tables=ROWS, buckets=8):
    store = stores.Store(spark, f"file://{tmp_path}/store", {t: ["id"] for t in SCHEMAS}, SCHEMAS, buckets)
    change = store.begin()
    for table, rows in tables.items():
        change.put(table, spark.createDataFrame(rows, SCHEMAS[table]))
    assert store.version() == 0 and store.read("fuentes").count() == 0
    assert change.commit() == 1
    return store


def ids(store, table):
    return sorted(r.id for r in store.read(table).collect())


def state_of(store):
    return {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in SCHEMAS}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    rows = [(i, 0, "ABIERTO") for i in range(200)]
    store = filled(spark, tmp_path, {"convocatorias": rows}, 32)
    before = store.files()
    new = spark.createDataFrame([(5, 9, "CERRADO"), (1000, 9, "ABIERTO")], SCHEMAS["convocatorias"])
    touched = store.begin().touched("convocatorias", new)
    change = store.begin()
    change.put("convocatorias", new)
    change.commit()
    after = store.files()
    assert 1 <= len(touched) <= 2 and len(before) > 20
    assert {k: f for k, f in after.items() if k[1] not in touched} == {k: f for k, f in before.items() if k[1] not in touched}
    assert all(after[("convocatorias", b)] != before.get(("convocatorias", b)) for b in touched)
    want = {i: (i, 0, "ABIERTO") for i in range(200)} | {5: (5, 9, "CERRADO"), 1000: (1000, 9, "ABIERTO")}
    assert sorted(map(tuple, store.read("convocatorias").collect())) == sorted(want.values())


def test_change_reads_touched_files_only(spark, tmp_path):
    store = filled(spark, tmp_path, {"convocatorias": [(i, 0, "x") for i in range(200)]}, 32)
    change = store.begin()
    read = change.read("convocatorias", {3, 4}).inputFiles()
    assert read and all("cubo=3/" in f or "cubo=4/" in f for f in read)


def test_lost_changes_leave_the_old_version(spark, tmp_path):
    store = filled(spark, tmp_path)
    before = state_of(store)
    stores.delete_sources(store, F.col("id") == 3, commit=False)  # killed between files and manifest
    (tmp_path / "store/commits/000000000002").touch()  # killed between marker and name
    assert store.version() == 1 and state_of(store) == before
    assert store.recover() > 0 and state_of(store) == before
    assert not (tmp_path / "store/commits/000000000002").exists()
    folders = {f.rsplit("/cubo=", 1)[0] for f in store.files().values()}
    assert {f"data/{t}/{n}" for t in store._names("data") for n in store._names(f"data/{t}")} == folders


def test_marker_of_a_lost_writer_is_no_obstacle(spark, tmp_path):
    store = filled(spark, tmp_path)
    (tmp_path / "store/commits/000000000002").touch()
    assert stores.delete_sources(store, F.col("id") == 3) == 2 and ids(store, "fuentes") == [1, 2]


def test_delete_with_children_in_one_commit(spark, tmp_path):
    store = filled(spark, tmp_path)
    before, files = state_of(store), store.files()
    with pytest.raises(stores.Restricted):
        stores.delete_sources(store, ~F.col("activa"))
    assert state_of(store) == before and store.files() == files
    stores.delete_sources(store, F.col("id") == 3)
    after = state_of(store)
    assert ids(store, "fuentes") == [1, 2] and {r[1] for r in after["snapshots"]} == {1, 2}
    assert {r[1] for r in after["convocatorias"]} == {1, 2} and {r[0] // 1000 for r in after["historial_cambios"]} == {1, 2}
    assert {r[0] // 10_000 for r in after["notificaciones"]} == {1, 2}
    assert after["audit_logs"] == [(7, 1), (8, None), (9, None)]
    assert store.version() == 2 and store.files(1) == files  # the version before is still there


def test_delete_of_calls(spark, tmp_path):
    store = filled(spark, tmp_path)
    stores.delete_calls(store, F.col("estado") == "CERRADO")
    assert ids(store, "convocatorias") == [r[0] for r in ROWS["convocatorias"] if r[2] == "ABIERTO"]
    assert ids(store, "historial_cambios") == [r[0] for r in ROWS["historial_cambios"] if r[1] % 100]
    assert ids(store, "notificaciones") == [r[0] for r in ROWS["notificaciones"] if r[1] % 1000]
    assert ids(store, "fuentes") == [1, 2, 3]


def test_of_two_changes_one_wins(spark, tmp_path):
    store = filled(spark, tmp_path)
    one, two = store.begin(), store.begin()
    one.delete("fuentes", spark.createDataFrame([(1,)], "id long"))
    two.delete("fuentes", spark.createDataFrame([(2,)], "id long"))
    one.commit()
    with pytest.raises(stores.Conflict):
        two.commit()
    assert ids(store, "fuentes") == [2, 3]


def test_everything_can_go_and_come_back(spark, tmp_path):
    store = filled(spark, tmp_path, {"audit_logs": ROWS["audit_logs"]})
    change = store.begin()
    change.delete("audit_logs", change.read("audit_logs"))
    change.delete("fuentes", spark.createDataFrame([(1,), (None,)], "id long"))
    change.commit()
    assert store.files() == {} and ids(store, "audit_logs") == []
    change = store.begin()
    change.put("audit_logs", spark.createDataFrame([(None, 1), (4, 2)], SCHEMAS["audit_logs"]))
    change.put("audit_logs", spark.createDataFrame([], SCHEMAS["audit_logs"]))
    change.put("audit_logs", spark.createDataFrame([(5, 3), (4, 3)], SCHEMAS["audit_logs"]))  # sees what came before it
    change.commit()
    assert sorted(map(tuple, store.read("audit_logs").collect()), key=str) == [(4, 3), (5, 3), (None, 1)]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    given = spark.conf.get(size)
    spark.conf.set(size, "20kb")
    try:
        store = stores.Store(spark, f"file://{tmp_path}/store", {"t": ["id"]}, {"t": "id long, nombre string"}, 1)
        change = store.begin()
        change.put("t", spark.range(0, 40_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("nombre")))
        change.delete("t", spark.range(10_000))
        change.commit()
    finally:
        spark.conf.set(size, given)
    rows = store.read("t")
    assert len(rows.inputFiles()) > 1 and rows.agg(F.count("*"), F.min("id"), F.sum("id")).first()[:] == (30_000, 10_000, sum(range(10_000, 40_000)))
