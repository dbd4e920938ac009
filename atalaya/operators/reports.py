"""Counts and reports. Every one aggregates before it joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.dates import at, days_to_close
from atalaya.operators.serving import with_source_name


def _is(status: str) -> Column:
    return F.col("estado") == status


def dashboard(sources: DataFrame, calls: DataFrame, history: DataFrame) -> DataFrame:
    """Seven totals in one row: one pass per table, the rows then folded."""
    parts = [
        sources.agg(
            F.count("*").alias("total_fuentes"),
            F.count_if("activa").alias("fuentes_activas"),
        ),
        calls.agg(
            F.count("*").alias("total_convocatorias"),
            F.count_if(_is("ABIERTO")).alias("convocatorias_abiertas"),
            F.count_if(_is("CERRADO")).alias("convocatorias_cerradas"),
        ),
        history.agg(
            F.count("*").alias("total_eventos"),
            F.count_if("es_relevante").alias("eventos_relevantes"),
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def calls_per_source(calls: DataFrame) -> DataFrame:
    return calls.groupBy("fuente_id").agg(
        F.count("*").alias("total_convocatorias"),
        F.count_if(_is("ABIERTO")).alias("abiertas"),
        F.count_if(_is("CERRADO")).alias("cerradas"),
    )


def last_capture(captures: DataFrame) -> DataFrame:
    return captures.groupBy("fuente_id").agg(F.max("fecha_captura").alias("ultima_ejecucion"))


def source_overview(sources: DataFrame, calls: DataFrame, captures: DataFrame) -> DataFrame:
    """Sources with call counts and the time of the last capture, by name."""
    base = sources.withColumnRenamed("id", "fuente_id")
    joined = base.join(calls_per_source(calls), "fuente_id", "left").join(
        last_capture(captures), "fuente_id", "left"
    )
    counts = ["total_convocatorias", "abiertas", "cerradas"]
    return joined.select(
        F.col("fuente_id").alias("id"),
        "nombre",
        "url_base",
        "activa",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        "ultima_ejecucion",
    ).orderBy("nombre")


def open_total(calls: DataFrame) -> DataFrame:
    """Grand total of open calls over the per-source counts."""
    return calls_per_source(calls).agg(
        F.coalesce(F.sum("abiertas"), F.lit(0)).alias("abiertas_total")
    )


def count_calls(selected: DataFrame) -> DataFrame:
    return selected.agg(F.count("*").alias("total"))


def quality_report(sources: DataFrame, calls: DataFrame) -> DataFrame:
    """Share of filled fields per active source; NULL shares where no calls."""
    filled = {
        "pct_cierre": "fecha_cierre",
        "pct_monto": "monto",
        "pct_region": "region",
        "pct_desc": "descripcion",
    }
    counts = calls.groupBy("fuente_id").agg(
        F.count("*").alias("total_items"), *[F.count(c).alias(n) for n, c in filled.items()]
    )
    active = sources.where("activa").select(
        F.col("id").alias("fuente_id"),
        F.col("nombre").alias("fuente"),
        F.coalesce("estrategia", F.lit("desconocida")).alias("estrategia"),
    )
    return (
        active.join(counts, "fuente_id", "left")
        .select(
            "fuente",
            "estrategia",
            F.coalesce("total_items", F.lit(0)).alias("total_items"),
            *[(F.col(n) / F.col("total_items") * 100).alias(n) for n in filled],
        )
        .orderBy("fuente")
    )


def quality_report_md(report: DataFrame) -> DataFrame:
    """The report's table rows as markdown, one line per source."""

    def pct(name: str) -> Column:
        shown = F.bround(F.col(name).cast("decimal(20,10)"), 1).cast("decimal(5,1)").cast("string")
        return F.coalesce(F.concat(shown, F.lit("%")), F.lit("-"))

    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            "fuente",
            F.concat(F.lit("`"), F.col("estrategia"), F.lit("`")),
            F.col("total_items").cast("string"),
            *[pct(n) for n in ("pct_cierre", "pct_monto", "pct_region", "pct_desc")],
        ),
        F.lit(" |"),
    )
    return report.select("fuente", line.alias("linea"))


def kpis(calls: DataFrame, as_of) -> DataFrame:
    """Open calls; closing within thirty days; sources with open calls; undated."""
    days = days_to_close(F.col("fecha_cierre"), at(as_of))
    return calls.where(_is("ABIERTO")).agg(
        F.count("*").alias("abiertas"),
        F.count_if((days >= 0) & (days <= 30)).alias("vencen_30"),
        F.count_distinct("fuente_id").alias("instituciones"),
        F.count_if(F.col("fecha_cierre").isNull()).alias("sin_fecha"),
    )


def briefing(calls: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """Open calls still to close, each with its source's section counts.

    One row per call, to be read in (source, closing date) order: a source's
    section is never gathered into one array.
    """
    now = at(as_of)
    days = days_to_close(F.col("fecha_cierre"), now)
    due = calls.where(_is("ABIERTO") & (F.col("fecha_cierre") >= now)).withColumn("dias", days)
    sections = due.groupBy("fuente_id").agg(
        F.count("*").alias("activas"),
        F.count_if((F.col("dias") >= 0) & (F.col("dias") <= 30)).alias("cierran_30d"),
    )
    return with_source_name(
        due.join(sections, "fuente_id"), sources, default="Sin institución"
    ).orderBy("fuente_nombre", "fecha_cierre", "id")


def run_summary(stages: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of one run: kept rows, discards per step, events.

    ``stages`` is the run's item table with ``motivo`` = NULL for kept rows or
    the step that dropped the row.
    """
    items = stages.agg(
        F.count("*").alias("leidas"),
        F.count_if(F.col("motivo").isNull()).alias("nuevas_encontradas"),
        F.count_if(F.col("motivo") == "normalizacion").alias("descartadas_normalizacion"),
        F.count_if(F.col("motivo") == "relevancia").alias("descartadas_relevancia"),
        F.count_if(F.col("motivo") == "vigencia").alias("descartadas_vigencia"),
    )
    found = events.agg(
        F.count("*").alias("eventos_generados"),
        F.count_if("es_relevante").alias("eventos_relevantes"),
    )
    both = items.unionByName(found, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
