"""Small text expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b\u0085\u00a0\u2028\u2029\u3000"
FOLD = "(?iU)"  # case folding and \b, \w, \s over the whole of Unicode


def any_of(alternatives: list[str]) -> str:
    """One case-insensitive whole-word pattern out of many alternatives."""
    return FOLD + r"\b(" + "|".join(alternatives) + r")\b"


def named_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that it names several times: in branches Spark would compute it for each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_group(c: Column, pattern: str | Column, group: int | Column = 1) -> Column:
    """Text of a capture group of the first match, NULL where nothing matches.

    The pattern and the group may be columns, so each row can carry its own.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    group = F.lit(group) if isinstance(group, int) else group
    return F.nullif(F.call_function("regexp_extract", c, pattern, group), F.lit(""))


def first_of(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[first_group(c, FOLD + p) for p in patterns])


def group_index(pattern: Column) -> Column:
    """1 where a pattern has a capture group, else 0 (the whole match)."""
    bare = F.regexp_replace(pattern, r"\\.|\[(?:\\.|[^\]\\])*\]", "")
    return F.when(F.regexp_like(bare, F.lit(r"\((?!\?)|\(\?<[A-Za-z]")), 1).otherwise(0)


def rule_extract(c: Column, pattern: Column, group: Column | None = None) -> Column:
    """Group 1, or the whole match of a pattern without groups, stripped.

    No match gives NULL; a missing pattern leaves the text as it is. ``group``
    is the pattern's ``group_index`` where that is at hand already. Spark keeps
    the last pattern of an extract compiled, a ``regexp_like`` on a column
    compiles it again for each row.
    """
    group = group_index(pattern) if group is None else group
    found = F.when(
        F.size(F.call_function("regexp_extract_all", c, pattern, F.lit(0))) > 0,
        strip(F.call_function("regexp_extract", c, pattern, group)),
    )
    return F.when(pattern.isNull(), c).otherwise(found)


def surrogate_id(label: str, text: Column) -> Column:
    """Stable id for an item without one: a label and ten md5 digits."""
    return F.concat(F.lit(label), F.substring(F.md5(text), 1, 10))


def stable_key(*parts: Column) -> Column:
    """Row id that a rerun computes again; NULL is a value of its own."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def squeeze_blank(c: Column) -> Column:
    """Whitespace clean-up of extracted text, keeping paragraphs."""
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def contains_fold(c: Column, needle: str) -> Column:
    """Case-insensitive substring test with the needle taken literally."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def strict_json(c: Column) -> Column:
    """The text as a variant; NULL unless the whole text is one JSON value.

    The parser stops after the first value and ignores what follows it. Inside
    two different wrappings, leftovers break at least one of them.
    """
    in_object = F.try_parse_json(F.concat(F.lit('[{"v":'), c, F.lit("\n}]")))
    in_list = F.try_parse_json(F.concat(F.lit('{"v":['), c, F.lit("\n]}")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$[0].v", "variant"))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters use without computing them again.

    A filter moves below a plain projection and takes its expressions along,
    so they would run twice; it does not move below a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
