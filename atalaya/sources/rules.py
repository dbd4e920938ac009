"""Rule documents: YAML texts to a typed rules table, bad ones set apart."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.functions.selectors import parse
from atalaya.functions.text import FOLD

ITEM = "struct<regex_extraction:string,formato_salida:string,idioma:string>"
SELECTORS = (
    "struct<contenedor_items:string,identificador:string,titulo:string,descripcion:string,"
    "link_detalle:string,estado:string,fecha_cierre:string,monto:string,region:string>"
)
PAGING = (
    "struct<total_pages_header:string,total_items_header:string,page_param:string,"
    "per_page_param:string,max_pages:int>"
)
MAPPING = (
    "struct<root_path:string,identificador:string,titulo:string,descripcion:string,"
    "link_detalle:string,estado:string,fecha_apertura:string,fecha_cierre:string,monto:string,"
    f"region:string,agrupar_por:string,paginacion:{PAGING}>"
)
RULES = (
    "struct<nombre:string,url_busqueda:string,estrategia:string,"
    f"selectores:{SELECTORS},json_mapping:{MAPPING},"
    f"normalizadores:struct<titulo:{ITEM},fecha_cierre:{ITEM},monto:{ITEM},region:{ITEM}>,"
    "alertas:struct<campos_sensibles:array<string>,ignorar_cambios_en:array<string>>,"
    "region_defecto:string,excluir_patrones_url:array<string>,excluir_patrones_titulo:array<string>>"
)


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of YAML files, one row per file: ``archivo, texto``."""
    files = spark.read.option("pathGlobFilter", "*.yaml").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("archivo"), F.col("value").alias("texto"))


DATE_CODES = frozenset("dmBbYyHMS")


def _good_pattern(pattern: str) -> bool:
    """A pattern that compiles, without what Spark's patterns read differently (a bracket inside a class, conditions)."""
    try:
        re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except (re.error, OverflowError):
        return False
    classes = re.findall(r"\\.|\[(\^?\]?(?:\\.|[^\]\\])*)\]", pattern, re.S)
    odd = any(re.search(r"\[|&&|^\^?\]", re.sub(r"\\.", "", c, flags=re.S)) for c in classes)
    return not odd and not re.search(r"\(\?\(|\(\?P?<[A-Za-z0-9]*_|\(\?P[=>]|\\Z", pattern)


def _spark_patterns(doc: dict) -> str | None:
    """Bring a document's patterns to Spark's form, or say what is wrong with one of them or with a selector."""
    for selector in (doc["selectores"] if isinstance(doc.get("selectores"), dict) else {}).values():
        if isinstance(selector, str) and selector != "self" and not selector.startswith("attr:"):
            try:
                parse(selector)
            except ValueError:
                return "selector_invalido"
    items = doc.get("normalizadores")
    for item in items.values() if isinstance(items, dict) else ():
        if not isinstance(item, dict):
            continue
        pattern, fmt = item.get("regex_extraction"), item.get("formato_salida")
        if pattern is not None:
            if not _good_pattern(str(pattern)):
                return "patron_invalido"
            item["regex_extraction"] = str(pattern).replace("(?P<", "(?<")
        if fmt is not None and not set(re.findall(r"%(.?)", str(fmt), re.S)) <= DATE_CODES:
            return "formato_invalido"
    titles = doc.get("excluir_patrones_titulo")
    if isinstance(titles, list):
        if not all(_good_pattern(str(t)) for t in titles):
            return "patron_invalido"
        doc["excluir_patrones_titulo"] = [str(t).replace("(?P<", "(?<") for t in titles]
    return None


def _yaml_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            doc = yaml.load(text, Loader=loader)
        except yaml.YAMLError:
            return None, "yaml_invalido"
        if not doc or not isinstance(doc, dict):
            return None, "no_es_diccionario"
        reason = _spark_patterns(doc)
        return json.dumps(doc, ensure_ascii=False, default=str), reason

    for pdf in batches:
        parsed = [one(t or "") for t in pdf["texto"]]
        yield pdf[["archivo"]].assign(
            documento=[p[0] for p in parsed], reject_reason=[p[1] for p in parsed]
        )


def load_rules(documents: DataFrame) -> DataFrame:
    """Typed rules of every document, with ``reject_reason`` (NULL = valid).

    A bad document never stops the others: patterns and date formats are tried
    here, so none of them can fail inside a run over all sources.
    """
    parsed = documents.select("archivo", "texto").mapInPandas(
        _yaml_batches, "archivo string, documento string, reject_reason string"
    )
    r = "reglas."
    typed = parsed.withColumn("reglas", F.from_json("documento", RULES, {"mode": "PERMISSIVE"}))

    def is_list(name: str):
        value = F.get_json_object("documento", f"$.{name}")
        return value.isNull() | value.startswith("[")

    lists = is_list("excluir_patrones_url") & is_list("excluir_patrones_titulo")
    has_selectors = F.get_json_object("documento", "$.selectores").isNotNull()
    has_mapping = F.get_json_object("documento", "$.json_mapping").isNotNull()
    reason = (
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(F.col(r + "nombre").isNull(), "falta_nombre")
        .when(~F.coalesce(F.col(r + "url_busqueda"), F.lit("")).rlike(FOLD + r"^https?://[^/\s]+"), "url_invalida")
        .when(
            has_selectors
            & F.array_contains(
                F.array(*[F.col(f"{r}selectores.{c}").isNull() for c in ("contenedor_items", "identificador", "titulo")]),
                True,
            ),
            "faltan_selectores",
        )
        .when(
            has_mapping
            & (F.col(r + "json_mapping.identificador").isNull() | F.col(r + "json_mapping.titulo").isNull()),
            "falta_json_mapping",
        )
        .when(~lists, "lista_invalida")
    )
    return typed.select(
        "archivo",
        "reglas.*",
        F.col("documento").alias("config"),
        reason.alias("reject_reason"),
    ).withColumn("estrategia", F.coalesce("estrategia", F.lit("html_static")))


def valid_rules(rules: DataFrame) -> DataFrame:
    return rules.where("reject_reason IS NULL").drop("reject_reason")


def normalizer_rules(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """The flat columns ``normalize_items`` reads, one row per source."""
    n = "normalizadores."
    flat = rules.select(
        "nombre",
        F.col(n + "fecha_cierre").isNotNull().alias("fecha_normaliza"),
        F.col(n + "fecha_cierre.regex_extraction").alias("fecha_regex"),
        F.col(n + "fecha_cierre.formato_salida").alias("fecha_formato"),
        F.col(n + "monto").isNotNull().alias("monto_normaliza"),
        F.col(n + "monto.regex_extraction").alias("monto_regex"),
        "region_defecto",
        "excluir_patrones_titulo",
        "excluir_patrones_url",
    )
    return (
        sources.select(F.col("id").alias("fuente_id"), "nombre", "url_base")
        .join(flat, "nombre")
        .drop("nombre")
    )
