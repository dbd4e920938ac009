"""URL expressions: relative resolution and query parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def _drop_dots(segments: Column) -> Column:
    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    closed = F.element_at(segments, -1).isin(".", "..")
    return F.when(closed, F.concat(kept, F.array(F.lit("")))).otherwise(kept)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link seen on a page, as a browser resolves it."""
    path, base_path = _part(href, 3), _part(base, 3)
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    query = F.when(href.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), _part(href, 4)))
    fragment = F.when(_part(href, 5) != "", F.concat(F.lit("#"), _part(href, 5)))
    folder = F.filter(
        F.split(F.regexp_replace(base_path, r"[^/]*$", ""), "/"), lambda s: s != ""
    )
    own = F.split(path, "/")
    inner = F.filter(F.slice(own, 1, F.size(own) - 1), lambda s: s != "")
    merged = F.concat(F.array(F.lit("")), folder, inner, F.array(F.element_at(own, -1)))
    rooted = path.startswith("/")
    segments = F.when(rooted, own).otherwise(merged)
    full = F.array_join(_drop_dots(segments), "/")
    full = F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))
    plain = ~path.rlike(r"(^|/)\.\.?(/|$)")
    target = (
        F.when(path == "", base_path)
        .when(plain & rooted, path)
        .when(plain, F.array_join(merged, "/"))
        .otherwise(full)
    )
    kept_query = F.when(
        (path == "") & query.isNull() & base.rlike(r"^[^#]*\?"),
        F.concat(F.lit("?"), _part(base, 4)),
    ).otherwise(query)
    return (
        F.when(href == "", base)
        .when(_part(href, 1) != "", href)
        .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
        .otherwise(F.concat_ws("", origin, target, kept_query, fragment))
    )


def join_rooted(href: Column, base: Column) -> Column:
    """Base and a path that starts with a slash; anything else is left alone."""
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(href, "^/+", ""))
    return F.when(href.startswith("/"), joined).otherwise(href)


def set_query_param(url: Column, name: str, value: Column) -> Column:
    """URL with one query parameter replaced where it stands, or added last."""
    head, query = _part(url, 3), _part(url, 4)
    origin = F.concat(_part(url, 1), F.lit("://"), _part(url, 2))
    fragment = F.when(_part(url, 5) != "", F.concat(F.lit("#"), _part(url, 5)))
    pair = F.concat(F.lit(f"{name}="), value.cast("string"))
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    is_named = lambda p: (p == name) | p.startswith(f"{name}=")
    at = F.array_position(F.transform(pairs, is_named), True)
    placed = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.when(~is_named(p), p).when(i == at - 1, pair),
        ),
        lambda p: p.isNotNull(),
    )
    query = F.when(at > 0, placed).otherwise(F.concat(pairs, F.array(pair)))
    return F.concat_ws("", origin, head, F.lit("?"), F.array_join(query, "&"), fragment)
