"""Delivery of outbox rows by channels that the user plugs in by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

#: Sends one outbox row and returns nothing, or says why it was not sent; whatever it raises counts as a failure.
Sender = Callable[[dict], str | None]
RESULT = "evento_id string, pos int, canal string, destinatario string, estado string, error_log string"
_RESULT = pa.schema([("evento_id", pa.string()), ("pos", pa.int32())] + [(n, pa.string()) for n in ("canal", "destinatario", "estado", "error_log")])


def _outcome(row: dict, channels: Mapping[str, Sender]) -> tuple[str, str | None]:
    if row["estado_envio"] != "PENDIENTE":
        return "SKIPPED", row["error_log"]
    if row["canal"] not in channels:
        return "SKIPPED", "canal desconocido"
    try:
        fault = channels[row["canal"]](row)
    except Exception as e:  # noqa: BLE001 - one channel's failure is a result row
        fault = str(e) or type(e).__name__
    return ("FALLIDO", fault) if fault else ("ENVIADO", None)


def deliver(outbox: DataFrame, channels: Mapping[str, Sender]) -> DataFrame:
    """One result row per outbox row; senders run where the rows are.

    Every action on the result sends again, and so does a task that is repeated: write it once, and let a channel
    that must not repeat itself look at the row's ``evento_id`` and ``pos``, which a rerun computes again.
    """
    channels = dict(channels)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                estado, fault = _outcome(row, channels)
                rows.append({n: row[n] for n in ("evento_id", "pos", "canal", "destinatario")} | {"estado": estado, "error_log": fault})
            yield pa.RecordBatch.from_pylist(rows, _RESULT)

    typed = outbox.withColumns({"evento_id": outbox["evento_id"].cast("string"), "pos": outbox["pos"].cast("int")})
    return typed.mapInArrow(send, RESULT)


def delivering(channels: Mapping[str, Sender], results: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: delivers a batch and writes its results to a folder of its own.

    A batch that is repeated after a failure replaces its folder, so every outbox row has one result row.
    """

    def batch(outbox: DataFrame, number: int) -> None:
        deliver(outbox, channels).write.mode("overwrite").parquet(f"{results}/lote={number}")

    return batch
