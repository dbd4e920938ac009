"""Status texts to the closed list of statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.text import FOLD, named_once, strip


def normalize_status(raw: Column, strict: bool = True) -> Column:
    """Canonical status of a raw text; never NULL.

    A canonical word stands for itself, then publication states, then the
    ordered patterns. ``strict=False`` also accepts an unaccented
    "proximamente" inside a longer text.
    """
    canonical = fixed.LIVE_STATUSES + fixed.CLOSED_STATUSES + [fixed.UNKNOWN_STATUS]
    patterns = [(p if strict else p.replace("Ó?X", "[ÓO]?X"), status) for p, status in fixed.STATUS_PATTERNS]

    def read(text: Column) -> Column:
        result = F.when(text.isNull() | (text == ""), fixed.UNKNOWN_STATUS)
        result = result.when(F.upper(text).isin(canonical), F.upper(text))
        for state, status in fixed.POST_STATUS.items():
            result = result.when(F.lower(text) == state, status)
        result = result.when(~text.rlike(FOLD + "|".join(p for p, _ in patterns)), fixed.UNKNOWN_STATUS)
        for pattern, status in patterns:
            result = result.when(text.rlike(FOLD + pattern), status)
        return result.otherwise(fixed.UNKNOWN_STATUS)

    return named_once(strip(raw), read)


def status_family(status: Column) -> Column:
    """Display family of a status text, by substring."""
    text = F.upper(F.coalesce(status, F.lit("")))

    def has(*parts: str) -> Column:
        return F.regexp_like(text, F.lit("|".join(parts)))

    return (
        F.when(has("ABIERT"), "green")
        .when(has("CERRAD", "FINALIZAD", "ADJUDICAD", "SUSPENDID"), "red")
        .when(has("PROXIM"), "amber")
        .when(has("DESCONOCID"), "gray")
        .otherwise("cyan")
    )
