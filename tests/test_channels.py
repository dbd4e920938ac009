"""Channels that the user plugs in, over a stream of outbox rows; keyset pages."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from atalaya.operators import serving
from atalaya.operators.channels import deliver, delivering

OUTBOX = "evento_id string, pos int, canal string, destinatario string, estado_envio string, error_log string, mensaje string"
ROWS = [
    ("e1", 0, "ARCHIVO", "a", "PENDIENTE", None, "hola"), ("e1", 1, "ROTO", "b", "PENDIENTE", None, "hola"),
    ("e1", 2, "NADIE", "c", "PENDIENTE", None, "hola"), ("e2", 0, "ARCHIVO", "a", "SKIPPED", "evento no relevante", "no"),
    ("e2", 1, "LLENO", "d", "PENDIENTE", None, "x"),
]
WANTED = {
    ("e1", 0, "ENVIADO", None), ("e1", 1, "FALLIDO", "sin red"), ("e1", 2, "SKIPPED", "canal desconocido"),
    ("e2", 0, "SKIPPED", "evento no relevante"), ("e2", 1, "FALLIDO", "buzon lleno"),
}


def channels(folder: str):
    def to_file(row):
        (Path(folder) / f"{row['evento_id']}-{row['pos']}").write_text(row["mensaje"])

    def broken(row):
        raise ConnectionError("sin red")

    return {"ARCHIVO": to_file, "ROTO": broken, "LLENO": lambda row: "buzon lleno"}


def outcome(df):
    return {(r.evento_id, r.pos, r.estado, r.error_log) for r in df.collect()}


def test_channels_of_a_table(spark, tmp_path):
    assert outcome(deliver(spark.createDataFrame(ROWS, OUTBOX), channels(str(tmp_path)))) == WANTED
    assert [(p.name, p.read_text()) for p in tmp_path.iterdir()] == [("e1-0", "hola")]
    assert deliver(spark.createDataFrame([], OUTBOX), {}).count() == 0


def test_channels_of_a_stream(spark, tmp_path):
    for name in ("in", "sent"):
        (tmp_path / name).mkdir()
    names = [c.split()[0] for c in OUTBOX.split(", ")]
    for n, part in enumerate((ROWS[:2], ROWS[2:])):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in part))
    stream = spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    batch = delivering(channels(str(tmp_path / "sent")), str(tmp_path / "out"))
    run = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert outcome(spark.read.parquet(str(tmp_path / "out"))) == WANTED
    assert len(list((tmp_path / "sent").iterdir())) == 1


def test_keyset_pages(spark):
    rows = [(i, None if i % 7 == 3 else f"2026-01-{1 + i % 5:02d}", f"2026-0{1 + i % 3}-01") for i in range(40)]
    calls = spark.createDataFrame(rows, "id int, actualizado_en string, fecha_cierre string")
    calls = calls.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("actualizado_en", "fecha_cierre")})
    for mode, column in (("actualizacion", "actualizado_en"), ("por_vencer", "fecha_cierre")):
        whole = [r.id for r in serving.ordered(calls, mode, "2025-01-01").collect()]
        page = serving.page_calls(calls, mode, 6, 0, "2025-01-01").collect()
        got = [r.id for r in page]
        while page:
            page = serving.page_calls_after(calls, (page[-1][column], page[-1].id), mode, 6, "2025-01-01").collect()
            got += [r.id for r in page]
        assert got == whole and len(got) == 40
