"""Spanish dates, configured formats and distances in time.

Every timestamp is a UTC wall-clock ``timestamp_ntz``, so no result depends
on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.text import FOLD, first_of, named_once, strip

DAY_MICROS = 86_400_000_000


def _valid_day(text: Column) -> Column:
    """Midnight of a ``year-month-day`` text; NULL for a day that does not exist."""
    day = text.try_cast("date").cast("timestamp_ntz")
    return F.when(~text.startswith("0000"), day)


def _month_number(name: Column) -> Column:
    names = {m: str(i + 1) for i, m in enumerate(fixed.MONTHS_ES)}
    names |= {m[:3]: str(i + 1) for i, m in enumerate(fixed.MONTHS_ES)}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(lookup, F.lower(name))


def parse_date_es(raw: Column) -> Column:
    """Date of a Spanish text: long form anywhere, else a whole short form.

    An impossible day gives NULL; an unknown month name leaves the short
    forms to try. Each form is read with one pass of its pattern.
    """
    whole = f"(?s){FOLD}^.*?{fixed.LONG_DATE}.*$"

    def long_form(parts: Column) -> Column:
        month = _month_number(F.get(parts, F.lit(1)))
        return F.when(month.isNotNull(), F.concat_ws("-", F.get(parts, F.lit(0)), month, F.get(parts, F.lit(2))))

    def read(text: Column) -> Column:
        parts = F.split(F.regexp_replace(text, whole, "$3-$2-$1"), "-")
        turned = F.regexp_replace(F.regexp_replace(text, fixed.SLASH_DATE, "$3-$2-$1"), fixed.DASH_DATE, "$3-$2-$1")
        short_form = named_once(
            turned, lambda t: F.when(t != text, t).when(text.rlike(fixed.ISO_DATE), F.substring(text, 1, 10))
        )
        return F.coalesce(named_once(F.when(F.contains(F.lower(text), F.lit("de")), parts), long_form), short_form)

    return named_once(named_once(strip(raw), read), _valid_day)


def spark_format(fmt: Column) -> Column:
    """A ``%d/%m/%Y`` style format as a Spark datetime pattern, per row."""
    codes = {
        "%d": "d", "%m": "M", "%B": "M", "%b": "M", "%Y": "yyyy", "%y": "yy",
        "%H": "H", "%M": "m", "%S": "s",
    }
    marks = [(code, chr(0xE000 + i), letters) for i, (code, letters) in enumerate(codes.items())]
    for code, mark, _ in marks:
        fmt = F.replace(fmt, F.lit(code), F.lit(mark))
    fmt = F.regexp_replace(F.replace(fmt, F.lit("'"), F.lit("''")), r"([A-Za-z#{}\[\]]+)", "'$1'")
    for _, mark, letters in marks:
        fmt = F.replace(fmt, F.lit(mark), F.lit(letters))
    return fmt


def parse_date_fmt(raw: Column, fmt: Column, pattern: Column | None = None) -> Column:
    """Date in a configured format; month names become numbers first, short ones where the format has ``%b``.

    ``pattern`` is the ``spark_format`` of the format where that is at hand already.
    """
    pattern = spark_format(fmt) if pattern is None else pattern

    def read(text: Column) -> Column:
        numbered = F.lit(None).cast("string")
        for number, name in reversed(list(enumerate(fixed.MONTHS_EN, 1))):
            numbered = F.when(
                F.contains(fmt, F.lit("%b")) & F.contains(text, F.lit(name[:3])),
                F.replace(text, F.lit(name[:3]), F.lit(str(number))),
            ).otherwise(numbered)
        for names in (fixed.MONTHS_EN, fixed.MONTHS_ES):
            for number, name in reversed(list(enumerate(names, 1))):
                numbered = F.when(
                    F.contains(text, F.lit(name)), F.replace(text, F.lit(name), F.lit(str(number)))
                ).otherwise(numbered)
        return F.coalesce(numbered, text)

    parsed = F.call_function("try_to_timestamp", named_once(F.lower(strip(raw)), read), pattern)
    return parsed.cast("timestamp_ntz")


def find_date(text: Column) -> Column:
    """First date text of a free text, by ordered patterns."""
    return first_of(text, fixed.FREE_TEXT_DATES)


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def days_to_close(closing: Column, as_of: Column) -> Column:
    """Whole days left, rounded up."""
    return F.ceil((_micros(closing) - _micros(as_of)) / F.lit(DAY_MICROS)).cast("int")


def urgency_band(days: Column, with_expired: bool = True) -> Column:
    band = F.when(days.isNull(), "none")
    if with_expired:
        band = band.when(days < 0, "expired")
    return band.when(days <= 10, "high").when(days <= 30, "mid").otherwise("low")


def urgency_text(days: Column) -> Column:
    """The label shown next to a deadline."""
    number = days.cast("string")
    return (
        F.when(days.isNull(), "Sin fecha")
        .when(days < 0, "Vencida")
        .when(days <= 10, F.concat(F.lit("⚡ "), number, F.lit("d")))
        .when(days <= 30, F.concat(F.lit("⏳ "), number, F.lit("d")))
        .otherwise(F.concat(number, F.lit("d restantes")))
    )


def recency_text(ts: Column, as_of: Column) -> Column:
    """How long ago something happened, in the largest whole unit."""
    minutes = F.floor((_micros(as_of) - _micros(ts)) / F.lit(60_000_000))
    hours = F.floor(minutes / 60)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(F.lit("hace "), n.cast("string"), F.lit(unit))

    return (
        F.when(ts.isNull(), "Nunca")
        .when(minutes < 1, "Ahora mismo")
        .when(minutes < 60, ago(minutes, "m"))
        .when(hours < 24, ago(hours, "h"))
        .otherwise(ago(F.floor(hours / 24), "d"))
    )


def at(as_of) -> Column:
    """``as_of`` as a timestamp column; a text or a column is accepted."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def months_before(as_of: Column, months: int) -> Column:
    """A month counts as thirty days."""
    return as_of - F.make_dt_interval(F.lit(months * fixed.DAYS_PER_MONTH))
