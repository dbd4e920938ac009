"""Change events as a stream: the last version of each call is Spark state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from atalaya import fixed_values as fixed
from atalaya.functions.text import stable_key
from atalaya.operators.changes import DELTA_LIST, KEY, render

OUTPUT = (
    "fuente_id string, identificador_externo string, convocatoria_id string, tipo string, "
    f"fecha_captura string, deltas {DELTA_LIST}"
)
OUTPUT_COLUMNS = [
    "fuente_id", "identificador_externo", "convocatoria_id", "tipo", "fecha_captura", "deltas",
]


def _compare_versions(fields: list[str]):
    """Per call: each version against the one before it by capture time.

    A version older than the stored one is ignored. State leaves when the
    watermark, which trails by the retention period, passes its last version.
    """
    columns = ["fecha_captura", *fields]

    def compare(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        batch = pd.concat(list(chunks)).sort_values(["fecha_captura", "orden"], kind="stable")
        out = []
        for raw in batch[columns].astype(object).itertuples(index=False, name=None):
            version = tuple(None if pd.isna(v) else v for v in raw)
            if before is not None and version[0] < before[0]:
                continue
            deltas = [
                {"campo": f, "valor_anterior": old, "valor_nuevo": new}
                for f, old, new in zip(fields, (before or version)[1:], version[1:], strict=True)
                if old != new
            ]
            if before is None or deltas:
                tipo = "APERTURA" if before is None else "MODIFICACION"
                out.append((*key, batch["convocatoria_id"].iloc[0], tipo, version[0], deltas))
            before = version
        state.update(before)
        last = int(batch["milis"].max())
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=OUTPUT_COLUMNS)

    return compare


def rendered(versions: DataFrame, fields: list[str], call_id: Column | None = None) -> DataFrame:
    """Versions as a state step reads them: texts of the fields, the capture time, and an order for equal times."""
    order = F.sha2(F.concat_ws("\x1f", *[F.col(f).cast("string") for f in fields]), 256)
    return versions.select(
        *[F.col(k).cast("string").alias(k) for k in KEY],
        (stable_key(*[F.col(k) for k in KEY]) if call_id is None else call_id.cast("string")).alias("convocatoria_id"),
        F.col("fecha_captura").cast("timestamp").alias("instante"),
        F.unix_millis(F.col("fecha_captura").cast("timestamp")).alias("milis"),
        F.date_format("fecha_captura", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fecha_captura"),
        order.alias("orden"),
        *[F.expr(render(f).format(f)).alias(f) for f in fields],
    )


def stream_changes(
    versions: DataFrame,
    fields: list[str] = fixed.COMPARED_FIELDS,
    retention_days: int = fixed.RETENTION_DAYS,
) -> DataFrame:
    """Openings and modifications out of a stream of call versions.

    ``versions``: the call key, ``fecha_captura`` and the compared fields. What
    one task holds of one key is bounded by the trigger's input
    (``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` of the source). The
    retention runs on capture time: a processing-time timeout would keep an
    ``availableNow`` run going forever.
    """
    rows = rendered(versions, fields)
    state = ", ".join(f"{f} string" for f in ["fecha_captura", *fields])
    timed = rows.withWatermark("instante", f"{retention_days} days")
    events = timed.groupBy(*KEY).applyInPandasWithState(
        _compare_versions(list(fields)),
        outputStructType=OUTPUT,
        stateStructType=state,
        outputMode="Update",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return events.withColumn("fecha_captura", F.col("fecha_captura").cast("timestamp_ntz"))


def with_relevance(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Add ``es_relevante`` from the alert rules (a static table next to the stream).

    Fields a source ignores are taken out first; a modification with no field
    left is no event.
    """
    rules = alerts.select(
        F.col("fuente_id").cast("string").alias("fuente_id"), "campos_sensibles", "ignorar_cambios_en"
    )
    opening = F.col("tipo") == "APERTURA"
    ignored = F.coalesce("ignorar_cambios_en", F.array().cast("array<string>"))
    fields = F.transform("deltas", lambda d: d.campo)
    kept = F.filter("deltas", lambda d: ~F.array_contains(F.col("_ignored"), d.campo))
    return (
        events.join(rules, "fuente_id", "left")
        .withColumn("_ignored", ignored)
        .withColumn("deltas", kept)
        .where(opening | (F.size("deltas") > 0))
        .withColumn(
            "es_relevante",
            opening | F.coalesce(F.arrays_overlap(fields, "campos_sensibles"), F.lit(False)),
        )
        .drop("_ignored", "campos_sensibles", "ignorar_cambios_en")
    )
