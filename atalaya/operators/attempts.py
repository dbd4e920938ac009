"""Fallback chains: which attempt of a source's run counts, and its metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ["fuente_id", "run_id"]


def run_outcomes(attempts: DataFrame, totals: Sequence[Column] = ()) -> DataFrame:
    """Final status and decisive step per run.

    ``attempts``: ``fuente_id, run_id, step, fetched, items, explicit_empty``
    with ``items`` NULL where extraction failed. The chain starts at the first
    step that fetched; the first step with items wins, unless an explicitly
    empty page stops the chain before it. ``totals`` are more aggregates of a
    run's attempts, taken in the same pass.
    """
    got = F.col("fetched") & (F.coalesce("items", F.lit(0)) > 0)
    empty = F.col("fetched") & (F.col("items") == 0) & F.col("explicit_empty")
    ends = attempts.groupBy(*RUN).agg(
        F.min(F.when(got, F.struct("step", "items"))).alias("ok"),
        F.min(F.when(empty, F.col("step"))).alias("empty_step"),
        F.bool_or("fetched").alias("any_fetch"),
        *totals,
    )
    wins = F.col("ok.step").isNotNull() & (
        F.col("empty_step").isNull() | (F.col("ok.step") < F.col("empty_step"))
    )
    return ends.select(
        *RUN,
        F.when(wins, F.col("ok.step")).otherwise(F.col("empty_step")).alias("step"),
        F.when(wins, F.col("ok.items")).otherwise(F.lit(0)).alias("total_items"),
        F.when(wins, "SUCCESS")
        .when(F.col("empty_step").isNotNull(), "SUCCESS_EMPTY")
        .when(~F.col("any_fetch"), "FETCH_FAILED")
        .otherwise("EXTRACTION_FAILED")
        .alias("final_status"),
        *ends.columns[len(RUN) + 3 :],
    )


def first_success(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """Items of each run's winning step only."""
    winners = run_outcomes(attempts).where("final_status = 'SUCCESS'").select(*RUN, "step")
    return items.join(winners, [*RUN, "step"], "left_semi")


def step_metrics(attempts: DataFrame) -> DataFrame:
    """Per run: steps tried, failed fetches, total latency, items, final status."""
    totals = [
        F.count("*").alias("pasos"),
        F.count_if(~F.col("fetched")).alias("fallidos"),
        F.sum("latency").alias("execution_time_seconds"),
    ]
    return run_outcomes(attempts, totals)
