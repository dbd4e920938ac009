"""Model responses as data: JSON out of noisy text, items out of JSON, context in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.status import normalize_status
from atalaya.functions.text import blank_to_null, compute_once, first_group, named_once, strict_json, strip


def recover_json(text: Column) -> Column:
    """The JSON value inside a text, as a variant; NULL where there is none.

    Tried in order: the whole text, a json fence, any fence, and the span from
    the first opening bracket to the last closing one of its kind.
    """
    return named_once(strip(text), _recovered)


def _recovered(clean: Column) -> Column:
    brace, bracket = F.locate("{", clean), F.locate("[", clean)

    def span(start: Column, closing: str) -> Column:
        end = F.length(clean) - F.locate(closing, F.reverse(clean)) + 1
        ok = (start > 0) & F.contains(clean, F.lit(closing)) & (end > start)
        return F.when(ok, F.substring(clean, start, end - start + 1))

    objects, arrays = span(brace, "}"), span(bracket, "]")
    object_first = (brace > 0) & ((bracket == 0) | (brace < bracket))
    tries = [
        clean,
        strip(first_group(clean, r"```json\s*([\s\S]+?)\s*```")),
        strip(first_group(clean, r"```\s*([\s\S]+?)\s*```")),
        F.when(object_first, objects).otherwise(arrays),
        F.when(object_first, arrays).otherwise(objects),
    ]
    return F.coalesce(*[named_once(t, strict_json) for t in tries])


def _list_at(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$['{key}']", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def item_list(doc: Column) -> Column:
    """The list of items of a recovered document, objects only.

    A list is taken as it is; of an object the first known key that holds a
    list, else the first value that is a list starting with an object.
    """
    known = [_list_at(doc, k) for k in fixed.RESPONSE_LIST_KEYS]
    values = F.map_values(F.try_variant_get(doc, "$", "map<string,variant>"))
    lists = F.transform(values, lambda v: F.try_variant_get(v, "$", "array<variant>"))
    other = F.try_element_at(
        F.filter(lists, lambda a: _is_object(F.try_element_at(a, F.lit(1)))), F.lit(1)
    )
    found = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), *known, other)
    return F.filter(found, _is_object)


def recover_items(responses: DataFrame, text: str = "text") -> DataFrame:
    """One row per item object of each response: ``pos, item`` (variant)."""
    kept = [c for c in responses.columns if c != text]
    read = compute_once(responses, _doc=recover_json(F.col(text)))
    listed = compute_once(read, _items=item_list(F.col("_doc")))
    return listed.select(*kept, F.posexplode("_items").alias("pos", "item"))


def responses_to_items(rows: DataFrame) -> DataFrame:
    """The seven item fields as text, blank to NULL, status normalized."""

    def value(name: str) -> Column:
        return blank_to_null(F.try_variant_get("item", f"$.{name}", "string"))

    fields = {f: value(f) for f in fixed.RESPONSE_FIELDS}
    fields["estado"] = normalize_status(fields["estado"])
    return rows.select(
        *[c for c in rows.columns if c != "item"], *[c.alias(f) for f, c in fields.items()]
    )


def pack_context(
    fragments: DataFrame,
    keys: list[str],
    whole_text: DataFrame | None = None,
    budget: int = fixed.CONTEXT_CHARS,
    fragment_chars: int | None = None,
) -> DataFrame:
    """Leading fragments of each page that fit a character budget, joined.

    ``fragments``: keys, ``pos`` (any numbers that order a page's fragments)
    and ``fragmento``. Empty fragments take nothing. It stops at the first
    fragment that does not fit; what is gathered per page is bounded by the
    budget. Fragments are cut only where ``fragment_chars`` is given. Pages
    where nothing fits fall back to the start of their text.
    """
    separator = fixed.FRAGMENT_SEPARATOR
    order = Window.partitionBy(*keys).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = fragments.where(F.col("fragmento") != "")
    if fragment_chars is not None:
        filled = filled.withColumn("fragmento", F.substring("fragmento", 1, fragment_chars))
    sized = (
        filled.withColumn("_size", F.length("fragmento"))
        .withColumn("_kept", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_n", F.row_number().over(order) - 1)
    )
    joined_so_far = F.col("_kept") + F.greatest(F.col("_n") - 1, F.lit(0)) * len(separator)
    over = (joined_so_far + F.col("_size") > budget).cast("int")
    fits = sized.withColumn("_over", over).withColumn(
        "_stopped", F.max("_over").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    texts = F.array_sort(F.collect_list(F.struct("pos", "fragmento")))
    packed = (
        fits.where("_stopped = 0")
        .groupBy(*keys)
        .agg(
            F.array_join(F.transform(texts, lambda t: t.fragmento), separator).alias("contexto"),
            F.count("*").alias("fragmentos"),
        )
    )
    if whole_text is None:
        return packed
    return whole_text.join(packed, keys, "left").select(
        *keys,
        F.coalesce("contexto", F.substring("texto", 1, budget)).alias("contexto"),
        F.coalesce("fragmentos", F.lit(0)).alias("fragmentos"),
    )
