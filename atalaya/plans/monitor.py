"""One monitoring run over all sources at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.operators.changes import KEY, detect_changes
from atalaya.operators.dedupe import dedupe_last
from atalaya.functions.text import stable_key
from atalaya.operators.filters import exclude_patterns, liveness_reason, relevance_reason
from atalaya.operators.mutate import upsert_calls
from atalaya.operators.normalize import normalize_items
from atalaya.operators.observed import STORED_AS
from atalaya.operators.reports import run_summary


@dataclass(frozen=True)
class Run:
    """What a run produces; nothing is computed before an output is read."""

    stages: DataFrame
    kept: DataFrame
    events: DataFrame
    calls: DataFrame
    rejected: DataFrame

    def summary(self) -> DataFrame:
        return run_summary(self.stages, self.events)


def run_stages(
    items: DataFrame,
    rules: DataFrame,
    as_of,
    order: list[str],
    months: int = fixed.LIVENESS_MONTHS,
    items_path: str | None = None,
) -> DataFrame:
    """Normalized items with ``motivo``: NULL if kept, else the step that drops.

    Order of the steps: normalize, keep the last row per key, relevance,
    liveness. Rows that a later copy of the same key replaces are gone, and
    so are items that their source's exclusion lists name, where the rules
    carry them.

    Good rows and rejected ones go different ways, so a plan that needs both
    normalizes every item twice. With ``items_path``, a new folder that all
    executors share, the normalized items are written there at once and both
    ways read them back.

    ``id`` is a hash of the key, which no file or shuffle can compress, so it
    is made when the rows have been through both.
    """
    if {"excluir_patrones_titulo", "excluir_patrones_url"} <= set(rules.columns):
        items = exclude_patterns(items, rules)
    read = normalize_items(items, rules, as_of).drop("id")
    if items_path:
        read.write.option("compression", STORED_AS).parquet(items_path)
        read = items.sparkSession.read.parquet(items_path)
    bad = F.col("reject_reason").isNotNull()
    good = dedupe_last(read.where(~bad), KEY, order)
    relevance = relevance_reason(F.col("titulo"), as_of, months)
    liveness = liveness_reason(F.col("estado"), F.col("fecha_cierre"), as_of, months)
    checked = good.withColumn(
        "motivo",
        F.when(relevance.isNotNull(), "relevancia").when(liveness.isNotNull(), "vigencia"),
    )
    stages = checked.unionByName(read.where(bad).withColumn("motivo", F.lit("normalizacion")))
    return stages.select(stable_key(*[F.col(c) for c in KEY]).alias("id"), "*")


def monitor_run(
    items: DataFrame,
    rules: DataFrame,
    alerts: DataFrame,
    stored: DataFrame,
    as_of,
    order: list[str],
    months: int = fixed.LIVENESS_MONTHS,
    stages_path: str | None = None,
    items_path: str | None = None,
) -> Run:
    """Items of a run to events and the next version of the calls.

    With ``stages_path``, a new folder that all executors share, the stages
    are written there at once and read back, so that extraction and
    normalization run once for all outputs. With ``items_path`` the same goes
    for the normalized items that good and rejected rows come from.
    """
    stages = run_stages(items, rules, as_of, order, months, items_path)
    if stages_path:
        stages.write.option("compression", STORED_AS).parquet(stages_path)
        stages = items.sparkSession.read.parquet(stages_path)
    kept = stages.where("motivo IS NULL").drop("motivo", "reject_reason")
    return Run(
        stages=stages,
        kept=kept,
        events=detect_changes(kept, stored, alerts),
        calls=upsert_calls(stored, kept, as_of),
        rejected=stages.where("motivo IS NOT NULL"),
    )


def audit_rows(rejected: DataFrame, run_id: str, as_of) -> DataFrame:
    """Audit log rows for what a run set apart; position and content tell rejects of one key apart."""
    own = ["id", "snapshot_id", "pos", "titulo", "url_detalle", "motivo", "reject_reason"]
    return rejected.select(
        stable_key(F.lit(run_id), *[F.col(c) for c in own if c in rejected.columns]).alias("id"),
        "fuente_id",
        F.lit("WARNING").alias("nivel"),
        F.col("motivo").alias("modulo"),
        F.coalesce("reject_reason", "motivo").alias("mensaje"),
        F.lit(as_of).cast("timestamp_ntz").alias("creado_en"),
    )
