"""Amounts: parsing, finding in free text, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.text import first_of, strip

AMOUNT = "decimal(15,2)"


def parse_amount(raw: Column) -> Column:
    """Dots group thousands, a comma marks decimals; NULL if not a number."""
    plain = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return strip(plain).try_cast(AMOUNT)


def find_amount(text: Column) -> Column:
    return strip(first_of(text, fixed.FREE_TEXT_AMOUNTS))


def amount_text(amount: Column) -> Column:
    """``$1.234`` as shown in messages."""
    shown = F.concat(F.lit("$"), F.translate(F.format_number(F.bround(amount, 0), 0), ",", "."))
    return F.coalesce(shown, F.lit("No definido"))
