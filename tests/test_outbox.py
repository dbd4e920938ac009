"""Fan-out to any number of channels."""

from pyspark.sql import functions as F

from atalaya.operators import outbox


def test_fanout_in_blocks_equals_one_array(spark, monkeypatch):
    events = spark.createDataFrame([(i, i % 2 == 0) for i in range(7)], "id long, es_relevante boolean")
    kinds = ["LOGGER", "TELEGRAM", "EMAIL", "OTHER"]
    rows = [(n, kinds[n % 4], '{"token": "t", "chat_id": "4"}' if n % 3 else "{}", n != 5) for n in range(23)]
    channels = spark.createDataFrame(rows, "pos int, tipo string, c string, activa boolean")
    channels = channels.withColumn("configuracion", F.try_parse_json("c")).drop("c")
    whole = sorted(map(tuple, outbox.notification_fanout(events, channels).collect()), key=str)
    monkeypatch.setattr(outbox, "CHANNEL_BLOCK", 4)
    found = outbox.notification_fanout(events, channels)
    assert sorted(map(tuple, found.collect()), key=str) == whole and len(whole) == 7 * 22
    assert found.columns == ["id", "es_relevante", "pos", "canal", "destinatario", "estado_envio", "error_log"]
    assert outbox.notification_fanout(events, channels.where("false")).count() == 0
