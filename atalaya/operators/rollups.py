"""Daily partial tables: counts and distinct sketches that are merged for any window, without the rows behind them.

A partial has one row per day and key. Counts add up exactly; distinct values are HyperLogLog sketches, whose estimate
has a relative standard error of about 1.04 / sqrt(2 ** LG_K).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "dia"
#: Sketches of 2 ** 12 registers, 2 KB each at most: 1.6 % standard error.
LG_K = 12


def daily_partials(
    rows: DataFrame, when: str, keys: Sequence[str], counts: Mapping[str, Column | None], distinct: Mapping[str, str]
) -> DataFrame:
    """One row per day of ``when`` and key: a count per condition (None: all rows), a sketch per column.

    Rows without a time have the day NULL; null values are in no sketch. Both parts are partial aggregates, so a hot key
    is combined before the shuffle.
    """
    totals = [(F.count("*") if c is None else F.count_if(c)).alias(n) for n, c in counts.items()]
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(n) for n, c in distinct.items()]
    return rows.groupBy(F.col(when).cast("date").alias(DAY), *keys).agg(*totals, *sketches)


def _aggregates(partials: DataFrame) -> tuple[list[str], list[str]]:
    """The columns that add up and the sketches of a partial without its keys."""
    kinds = {f.name: f.dataType.simpleString() for f in partials.schema}
    sketches = [n for n, kind in kinds.items() if kind == "binary"]
    sums = [n for n, kind in kinds.items() if kind == "bigint"]
    return sums, sketches


def merge_partials(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partials of new rows added to the stored ones; days that only one side has stay as they are."""
    both = old.unionByName(new)
    sums, sketches = _aggregates(both.drop(*keys))
    return both.groupBy(DAY, *keys).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.hll_union_agg(c).alias(c) for c in sketches]
    )


def over_window(partials: DataFrame, first, last, keys: Sequence[str] = (), undated: bool = False) -> DataFrame:
    """Counts and distinct estimates of the days from ``first`` to ``last``, both included, per ``keys``.

    ``undated`` takes rows without a day too; None leaves a side open. Without keys an empty window gives one row of zeros.
    """
    inside = F.lit(True)
    if first is not None:
        inside &= F.col(DAY) >= F.lit(str(first)).cast("date")
    if last is not None:
        inside &= F.col(DAY) <= F.lit(str(last)).cast("date")
    none = F.col(DAY).isNull()
    inside = F.coalesce(inside, F.lit(False)) & ~none
    sums, sketches = _aggregates(partials.drop(*keys))
    return (
        partials.where(inside | none if undated else inside)
        .groupBy(*keys)
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
            *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in sketches],
        )
    )
