"""Change events of a stream that knows the stored calls: state begins as the stored table, versions may come in any order.

A version waits in state until the watermark has passed it, so late arrivals within ``delay`` are compared in the
order of their capture times, whatever batch brought them. The last version of every call can be read back as a
table and be the beginning of another stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from atalaya import fixed_values as fixed
from atalaya.operators.changes import KEY
from atalaya.streaming.changes import OUTPUT, OUTPUT_COLUMNS, rendered

DAY_MS = 86_400_000


class Versions(StatefulProcessor):
    """Per call: the last version (a value), the versions still to compare (a list), and one timer for what comes next."""

    def __init__(self, fields: list[str], retention_ms: int) -> None:
        self.fields, self.retention_ms = fields, retention_ms
        self.columns = ["fecha_captura", "milis", "orden", "convocatoria_id", *fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        texts = ", ".join(f"{f} string" for f in self.fields)
        schema = f"fecha_captura string, milis bigint, orden string, convocatoria_id string, {texts}"
        self.handle = handle
        self.last = handle.getValueState("version", schema)
        self.waiting = handle.getListState("pendientes", schema)

    def _rows(self, chunks: Iterator[pd.DataFrame]) -> list[tuple]:
        got = pd.concat(list(chunks))[self.columns].astype(object)
        return [tuple(None if pd.isna(v) else v for v in row) for row in got.itertuples(index=False, name=None)]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        newest = max(self._rows(iter([initialState])), key=lambda r: r[:3])
        self.last.update(newest)
        self.handle.registerTimer(newest[1] + self.retention_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = self._rows(rows)
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: tuple(r)[:3]) if self.waiting.exists() else []
        due = [tuple(r) for r in waiting if r[1] <= reached]
        later = [tuple(r) for r in waiting[len(due) :]]
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for row in due:
            if before is None:
                out.append((*key, row[3], "APERTURA", row[0], []))
            elif row[:1] < before[:1]:
                continue
            else:
                row = (*row[:3], before[3], *row[4:])
                deltas = [
                    {"campo": f, "valor_anterior": old, "valor_nuevo": new}
                    for f, old, new in zip(self.fields, before[4:], row[4:], strict=True)
                    if old != new
                ]
                if deltas:
                    out.append((*key, row[3], "MODIFICACION", row[0], deltas))
            before = row
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][1])
        elif due:
            self.waiting.clear()
        if before is not None and not later and before[1] + self.retention_ms <= reached:
            self.last.clear()
        elif before is not None:
            if due:
                self.last.update(before)
            if not later:
                self.handle.registerTimer(before[1] + self.retention_ms)
        if out:
            yield pd.DataFrame(out, columns=OUTPUT_COLUMNS)

    def close(self) -> None:
        pass


def stream_changes_stored(
    versions: DataFrame,
    stored: DataFrame,
    fields: list[str] = fixed.COMPARED_FIELDS,
    delay: str = "1 hour",
    retention_days: int = fixed.RETENTION_DAYS,
) -> DataFrame:
    """Openings and modifications of a stream against the stored calls and against earlier versions of the stream.

    ``versions``: the call key, ``fecha_captura`` and the compared fields. ``stored``: the same columns and ``id``, which
    wins over a new one; it is read by the first batch of a checkpoint only, of several rows of one call the newest
    counts, and rows without a time count as oldest. A version comes out once the watermark (``delay`` behind the newest capture) has reached it; rows that
    arrive behind the watermark are dropped and counted by Spark. A version older than the stored one is ignored, equal
    times are taken in the order of a digest of their fields, rows without a capture time are left out, and null keys
    are a call like any other. A call's state leaves when the watermark is ``retention_days`` past its last version; this
    runs on capture time by a timer, since a processing-time limit would keep an ``availableNow`` run going forever.
    What a task holds of one call is bounded by the trigger's input and by the versions within ``delay``.
    """
    names = list(fields)
    timed = rendered(versions, names).where(F.col("instante").isNotNull()).withWatermark("instante", delay)
    oldest = F.lit("1970-01-01").cast("timestamp_ntz")
    dated = stored.withColumn("fecha_captura", F.coalesce(F.col("fecha_captura").cast("timestamp_ntz"), oldest))
    known = rendered(dated, names, F.col("id"))
    events = timed.groupBy(*KEY).transformWithStateInPandas(
        Versions(names, retention_days * DAY_MS), OUTPUT, "Append", "EventTime", initialState=known.groupBy(*KEY)
    )
    return events.withColumn("fecha_captura", F.col("fecha_captura").cast("timestamp_ntz"))


def last_versions(spark: SparkSession, checkpoint: str, waiting: bool = False) -> DataFrame:
    """The last version of every call as the state under a checkpoint holds it: key, ``id``, ``fecha_captura``, texts of the fields.

    With ``waiting`` the versions that the watermark has not reached yet. Another stream may begin from the table.
    """
    kind = "pendientes" if waiting else "version"
    state = spark.read.format("statestore").option("stateVarName", kind).load(checkpoint)
    value = "list_element" if waiting else "value"
    flat = state.select("key.*", f"{value}.*").withColumnRenamed("convocatoria_id", "id").drop("milis", "orden")
    return flat.withColumn("fecha_captura", F.col("fecha_captura").cast("timestamp_ntz"))
