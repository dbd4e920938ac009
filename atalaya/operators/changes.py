"""Change detection between the stored calls and a new run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.text import stable_key

KEY = ["fuente_id", "identificador_externo"]


def render(field: str) -> str:
    """SQL text form of a field's value inside a delta (one form for both sides)."""
    if field.startswith("fecha_"):
        return "concat(date_format({0}, 'yyyy-MM-dd HH:mm:ss'), '+00:00')"
    return "cast({0} as string)"


def deltas(old: str, new: str, ignored: Column, fields: Sequence[str]) -> Column:
    """Array of the fields that differ between two structs, in field order."""
    changes = F.array(
        *[
            F.struct(
                F.lit(f).alias("campo"),
                F.expr(render(f).format(f"{old}.{f}")).alias("valor_anterior"),
                F.expr(render(f).format(f"{new}.{f}")).alias("valor_nuevo"),
                (~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}"))).alias("distinto"),
            )
            for f in fields
        ]
    )
    kept = F.filter(changes, lambda d: d.distinto & ~F.array_contains(ignored, d.campo))
    return F.transform(kept, lambda d: F.struct(d.campo, d.valor_anterior, d.valor_nuevo))


def _names(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def compare(
    new: DataFrame,
    old: DataFrame,
    alerts: DataFrame,
    fields: Sequence[str] = fixed.COMPARED_FIELDS,
) -> DataFrame:
    """New rows next to their stored version, with deltas and the alert rule.

    ``alerts``: ``fuente_id, campos_sensibles, ignorar_cambios_en``. Only the
    compared columns cross the shuffle. The stored id wins over the new one.
    """
    before = old.select(*KEY, F.struct("id", *fields).alias("antes"))
    after = new.select(*KEY, F.struct("id", *fields).alias("ahora"))
    joined = after.join(before, KEY, "left").join(
        alerts.select("fuente_id", "campos_sensibles", "ignorar_cambios_en"), "fuente_id", "left"
    )
    return joined.select(
        *KEY,
        F.coalesce(F.col("antes.id"), F.col("ahora.id")).alias("convocatoria_id"),
        F.col("antes").isNull().alias("es_apertura"),
        deltas("antes", "ahora", _names(F.col("ignorar_cambios_en")), fields).alias("deltas"),
        _names(F.col("campos_sensibles")).alias("campos_sensibles"),
    )


def detect_changes(
    new: DataFrame,
    old: DataFrame,
    alerts: DataFrame,
    fields: Sequence[str] = fixed.COMPARED_FIELDS,
) -> DataFrame:
    """Change events: an opening for a new key, a modification where fields differ.

    Openings are always relevant; a modification is relevant when a changed
    field is a sensitive one. Rows without a difference give no event.
    """
    opening = F.col("es_apertura")
    changed = F.transform("deltas", lambda d: d.campo)
    return (
        compare(new, old, alerts, fields)
        .where(opening | (F.size("deltas") > 0))
        .select(
            "convocatoria_id",
            *KEY,
            F.when(opening, "APERTURA").otherwise("MODIFICACION").alias("tipo"),
            F.when(opening, F.filter("deltas", lambda d: F.lit(False)))
            .otherwise(F.col("deltas"))
            .alias("deltas"),
            (opening | F.arrays_overlap(changed, "campos_sensibles")).alias("es_relevante"),
        )
    )


def detect_openings(new: DataFrame, old: DataFrame) -> DataFrame:
    """New keys only: an anti join, nothing to compare."""
    return new.join(old.select(*KEY), KEY, "left_anti")


def detect_missing(new: DataFrame, old: DataFrame) -> DataFrame:
    """Stored keys that the run no longer has (a report, never an event)."""
    return old.join(new.select(*KEY), KEY, "left_anti")


def event_log(events: DataFrame, snapshot_id: Column, detected_at: Column) -> DataFrame:
    """Events as rows of the change history, deltas as JSON text."""
    return events.select(
        stable_key(F.col("convocatoria_id"), detected_at).alias("id"),
        "convocatoria_id",
        snapshot_id.alias("snapshot_id"),
        detected_at.alias("fecha_deteccion"),
        (F.col("tipo") == "APERTURA").alias("es_apertura"),
        F.to_json("deltas", {"ignoreNullFields": "false"}).alias("delta"),
        "es_relevante",
    )


DELTA_LIST = "array<struct<campo:string,valor_anterior:string,valor_nuevo:string>>"


def read_deltas(history: DataFrame) -> DataFrame:
    """Change history with typed deltas; a missing name reads as empty text."""
    parsed = F.from_json("delta", DELTA_LIST)
    return history.withColumns(
        {
            "deltas": F.transform(
                parsed,
                lambda d: F.struct(
                    F.coalesce(d.campo, F.lit("")).alias("campo"),
                    d.valor_anterior.alias("valor_anterior"),
                    d.valor_nuevo.alias("valor_nuevo"),
                ),
            ),
            "tipo": F.when(F.col("es_apertura"), "APERTURA").otherwise("MODIFICACION"),
        }
    ).drop("delta")
