"""Exclusion lists of any length: patterns are found by a trigram of text they need, and tried on those rows only.

A pattern without alternatives, groups, classes, escapes, flags and optional parts must contain its plain stretches, so its
match contains their trigrams. Each pattern is listed under the one of its trigrams that fewest patterns of its list
need; an equi join on (list, trigram) gives the candidates, and only they are matched. Patterns without such a trigram are
tried on every text of their list, as `filters.exclude_patterns` tries all of them.

Sources with the same patterns share a list, and a list's texts are matched once, not once for each source that has them.
Lists that many sources name need not be copied to each of them: they can be given beside the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.operators.filters import is_excluded_by_rule

#: What makes a pattern's plain stretches optional or hides them.
NOT_PLAIN = r"[\\|()\[\]{}?*]"
#: What ends a plain stretch of the other patterns: any character, repeats, anchors.
BREAKS = r"[.^$+]"
#: The column that each kind of pattern is tried on, and the one that lists them.
FIELDS = {"titulo": "titulo", "url": "url_detalle"}
LISTS = {"titulo": "excluir_patrones_titulo", "url": "excluir_patrones_url"}


def folded(text: Column) -> Column:
    """One form of all case variants, the same for a stretch wherever it stands (final sigma, the dot of a lowered İ)."""
    return F.translate(F.lower(F.upper(F.lower(text))), "ς\u0307", "σ")


def trigrams(text: Column) -> Column:
    """Distinct three-character stretches; none for shorter texts."""
    short = F.array().cast("array<string>")
    return F.when(
        F.length(text) >= 3,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)))),
    ).otherwise(short)


def _digest(of: Column) -> Column:
    return F.sha2(F.to_json(F.struct(of.alias("x"))), 256)


def shared_lists(rules: DataFrame, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct pattern lists (``lista`` and the two arrays), and the lists of each source (``fuente_id, lista``).

    A rule's own arrays are a list named by a digest of what they hold; ``listas`` of a rule names rows of ``lists``.
    """
    arrays = [F.array_sort(F.array_distinct(F.coalesce(F.array_compact(c), F.array().cast("array<string>")))).alias(c) for c in LISTS.values()]
    own = rules.where("fuente_id is not null").select("fuente_id", *(["listas"] if lists is not None else []), *arrays)
    own = own.withColumn("lista", F.concat(F.lit("propia-"), _digest(F.struct(*LISTS.values()))))
    some = " or ".join(f"size({c}) > 0" for c in LISTS.values())
    held = own.where(some)
    members, known = held.select("fuente_id", "lista"), held.groupBy("lista").agg(*[F.any_value(c).alias(c) for c in LISTS.values()])
    if lists is not None:
        named = F.concat(F.lit("dada-"), F.col("lista").cast("string")).alias("lista")
        members = members.unionByName(own.select("fuente_id", F.explode("listas").alias("lista")).where("lista is not null").select("fuente_id", named))
        known = known.unionByName(lists.select(named, *arrays).where(some))
    return known, members.distinct()


def _listed(lists: DataFrame) -> DataFrame:
    """One row per distinct pattern of a list: its kind, and the trigrams it needs."""
    of_kind = [lists.select("lista", F.lit(k).alias("campo"), F.explode(c).alias("patron")) for k, c in LISTS.items()]
    plain = ~F.col("patron").rlike(NOT_PLAIN)
    stretches = F.transform(F.split("patron", BREAKS), lambda s: trigrams(folded(s)))
    needed = F.when(F.col("campo") == "url", trigrams(F.lower("patron"))).when(plain, F.array_distinct(F.flatten(stretches)))
    none = F.array().cast("array<string>")
    return of_kind[0].unionByName(of_kind[1]).distinct().withColumn("necesita", F.coalesce(needed, none))


def pattern_index(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns by one trigram each, and the patterns without one, a row per list and kind.

    ``lists``: ``lista, excluir_patrones_titulo, excluir_patrones_url`` (arrays without nulls).
    """
    listed = _listed(lists)
    each = listed.where(F.size("necesita") > 0).select("lista", "campo", "patron", F.explode("necesita").alias("trigrama"))
    asked = each.groupBy("lista", "campo", "trigrama").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "trigrama"))["trigrama"].alias("trigrama")
    index = each.join(asked, ["lista", "campo", "trigrama"]).groupBy("lista", "campo", "patron").agg(rarest)
    rest = listed.where(F.size("necesita") == 0).groupBy("lista", "campo").agg(F.collect_list("patron").alias("patrones"))
    return index, rest


def excluded_texts(texts: DataFrame, index: DataFrame, rest: DataFrame, kind: str) -> DataFrame:
    """Of distinct (``lista, texto``) of one kind those that a pattern of the list names."""
    index, rest = (x.where(F.col("campo") == kind).drop("campo") for x in (index, rest))
    form = folded(F.col("texto")) if kind == "titulo" else F.lower("texto")
    has = texts.select("lista", "texto", F.explode(trigrams(form)).alias("trigrama"))
    by_title = F.regexp_like("texto", F.concat(F.lit("(?iU)"), F.col("patron")))
    by_url = F.contains(F.lower("texto"), F.lower("patron"))
    found = has.join(index, ["lista", "trigrama"]).where(by_title if kind == "titulo" else by_url).select("lista", "texto")
    tried = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    text, patterns = F.col("texto"), F.col("patrones")
    hit = is_excluded_by_rule(text, tried[0], patterns, tried[1]) if kind == "titulo" else is_excluded_by_rule(tried[0], text, tried[1], patterns)
    return found.unionByName(texts.join(rest, "lista").where(hit).select("lista", "texto")).distinct()


def exclude_by_index(items: DataFrame, rules: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Items that no pattern of their source names: the rows of `filters.exclude_patterns`, for lists of any length.

    ``rules``: ``fuente_id, excluir_patrones_titulo, excluir_patrones_url`` (arrays, may be null); with ``lists`` also ``listas``,
    the names (``lista``) of the rows of ``lists`` that hold for the source besides its own patterns.
    Null titles and URLs match nothing; equal texts of a list are matched once and all stay or all go. An empty URL part
    is in every URL and takes all items of its source that have one.
    """
    known, members = shared_lists(rules, lists)
    index, rest = pattern_index(known)
    # Sources with the same lists are one group: what is matched and what is taken out depends on the group alone.
    groups = members.groupBy("fuente_id").agg(F.array_sort(F.collect_set("lista")).alias("listas")).withColumn("_grupo", _digest(F.col("listas")))
    grouped = items.join(groups.select(F.col("fuente_id").alias("_fuente"), "_grupo"), F.col("fuente_id") == F.col("_fuente"), "left").drop("_fuente")
    left = grouped
    for kind, field in FIELDS.items():
        used = known.where(F.size(LISTS[kind]) > 0).select("lista")
        lists_of = groups.select("_grupo", F.explode("listas").alias("lista")).distinct().join(used, "lista")
        texts = grouped.select("_grupo", F.col(field).alias("texto")).where("_grupo is not null and texto is not null")
        texts = texts.join(lists_of.select("_grupo").distinct(), "_grupo", "left_semi").distinct()
        asked = texts.join(lists_of, "_grupo")
        found = excluded_texts(asked.select("lista", "texto").distinct(), index, rest, kind)
        gone = asked.join(found, ["lista", "texto"], "left_semi").select(F.col("_grupo").alias("_g"), F.col("texto").alias("_t")).distinct()
        left = left.join(gone, (F.col("_grupo") == F.col("_g")) & (F.col(field) == F.col("_t")), "left_anti")
    return left.drop("_grupo")
