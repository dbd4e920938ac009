"""Items out of JSON captures, by dot paths that each source declares."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.status import normalize_status
from atalaya.functions.text import blank_to_null, compute_once, strict_json

TEXT_FIELDS = ["titulo", "descripcion", "estado", "fecha_apertura", "fecha_cierre", "monto", "region"]


@dataclass(frozen=True)
class JsonMapping:
    """Dot paths of one source's response; a number steps into a list."""

    identificador: str
    titulo: str
    root_path: str | None = None
    descripcion: str | None = None
    link_detalle: str | None = None
    estado: str | None = None
    fecha_apertura: str | None = None
    fecha_cierre: str | None = None
    monto: str | None = None
    region: str | None = None
    agrupar_por: str | None = None


def variant_paths(path: str | None) -> list[str]:
    """Variant paths for a dot path: each number is a list position or a name, as the value at that step is."""
    if not path:
        return ["$"]

    def step(p: str) -> list[str]:
        name = "['" + p.replace("'", "\\'") + "']"
        return [f"[{p}]", name] if p.isdigit() else [name]

    return ["$" + "".join(steps) for steps in product(*map(step, path.split(".")))]


def at_path(value: Column, path: str | None, kind: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(value, p, kind) for p in variant_paths(path)])


def extract_json(
    captures: DataFrame, mapping: JsonMapping, body: str = "contenido_crudo"
) -> DataFrame:
    """Captures with their ``items`` array and a ``reject_reason`` (NULL = good).

    One item without an id or a title, or a root that is no list, rejects the
    whole capture. All items of a capture are in its row, so neither the test
    nor the positions need a shuffle.
    """

    def text(v: Column, path: str | None) -> Column:
        return blank_to_null(at_path(v, path)) if path else F.lit(None).cast("string")

    def item(v: Column, i: Column) -> Column:
        fields = {"identificador": text(v, mapping.identificador)}
        fields |= {f: text(v, getattr(mapping, f)) for f in TEXT_FIELDS}
        fields["estado"] = normalize_status(fields["estado"])
        fields["url_detalle"] = text(v, mapping.link_detalle)
        fields["grupo"] = text(v, mapping.agrupar_por)
        return F.struct(i.alias("pos"), *[c.alias(n) for n, c in fields.items()])

    parsed = compute_once(captures, _doc=strict_json(F.col(body)))
    parsed = compute_once(parsed, _list=at_path(F.col("_doc"), mapping.root_path, "array<variant>"))
    items = compute_once(parsed, items=F.transform("_list", item))
    incomplete = F.exists("items", lambda x: x.identificador.isNull() | x.titulo.isNull())
    reason = (
        F.when(F.col("_doc").isNull(), "json_invalido")
        .when(F.col("_list").isNull(), "raiz_no_es_lista")
        .when(incomplete, "item_incompleto")
    )
    return items.withColumn("reject_reason", reason).drop("_doc", "_list", body)


def explode_items(extracted: DataFrame) -> DataFrame:
    """Item rows of the good captures."""
    kept = [c for c in extracted.columns if c not in ("items", "reject_reason")]
    return extracted.where("reject_reason IS NULL").select(*kept, F.inline("items"))


def rejected_captures(extracted: DataFrame) -> DataFrame:
    """Captures set apart, for the audit log."""
    return extracted.where("reject_reason IS NOT NULL").drop("items")


def _without_region(title: Column) -> Column:
    first, second = fixed.GROUP_TITLE_CUTS

    def cut(mark: str) -> Column:
        return F.trim(F.substring_index(title, mark, 1))

    return (
        F.when(F.contains(title, F.lit(first)), cut(first))
        .when(F.contains(title, F.lit(second)), cut(second))
        .otherwise(title)
    )


def group_merge_regions(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its first item, with the regions of all its items.

    A region is added when the text so far does not contain it already, so
    only the first place of each distinct region matters: regions are reduced
    to (region, first position) before a group comes together. Rows without a
    group stand for themselves; of equal ids the last one counts.
    """
    group = [*keys, "grupo"]
    grouped = items.where("grupo IS NOT NULL")
    fields = [c for c in items.columns if c not in (*group, "identificador", "region")]
    per_region = grouped.groupBy(*group, "region").agg(
        F.min("pos").alias("_at"), F.min_by(F.struct(*fields), "pos").alias("_first")
    )
    listed = F.array_sort(
        F.collect_list(F.when(F.col("region").isNotNull(), F.struct("_at", "region")))
    )
    merged = per_region.groupBy(*group).agg(
        F.min_by("_first", "_at").alias("_first"),
        F.min_by("region", "_at").alias("_region"),
        listed.alias("_regions"),
    )
    joined = F.aggregate(
        "_regions",
        F.col("_region"),
        lambda text, r: F.when(F.contains(text, r.region), text).otherwise(
            F.concat(text, F.lit(", "), r.region)
        ),
    )
    out = merged.select(
        *keys,
        "grupo",
        F.col("grupo").alias("identificador"),
        F.when(F.col("_region").isNotNull(), joined).alias("region"),
        "_first.*",
    ).withColumn("titulo", _without_region(F.col("titulo")))
    single = [*keys, "identificador"]
    rest = [c for c in items.columns if c not in single]
    alone = (
        items.where("grupo IS NULL")
        .groupBy(*single)
        .agg(F.max_by(F.struct(*rest), "pos").alias("_row"))
        .select(*single, "_row.*")
    )
    return out.unionByName(alone)
