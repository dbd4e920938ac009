"""The counts of a run taken while its items are written, so that nothing is read again for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

STEPS = ("normalizacion", "relevancia", "vigencia")

#: A run's files hold each item whole, with hashes that only an entropy coder makes shorter.
STORED_AS = "zstd"


def write_observed(items: DataFrame, path: str, reason: str = "motivo", steps: Sequence[str] = STEPS) -> dict[str, int]:
    """Write a run's items with their reject reason, by reason in folders; return the counts of ``reports.run_summary``.

    ``reason`` is NULL for rows that stay. Reasons other than ``steps`` count as ``descartadas_otras``. The counts are
    taken in the tasks that write, whose results Spark takes once each, also when a lost executor's tasks run again.
    """
    taken = Observation()
    known = F.coalesce(F.col(reason).isin(*steps), F.lit(False))
    items.observe(
        taken,
        F.count(F.lit(1)).alias("leidas"),
        F.count_if(F.col(reason).isNull()).alias("nuevas_encontradas"),
        *[F.count_if(F.col(reason) == step).alias(f"descartadas_{step}") for step in steps],
        F.count_if(F.col(reason).isNotNull() & ~known).alias("descartadas_otras"),
    ).write.partitionBy(reason).option("compression", STORED_AS).parquet(path)
    return {name: int(n or 0) for name, n in taken.get.items()}
