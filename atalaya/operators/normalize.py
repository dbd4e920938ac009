"""Raw items to calls: required fields, status, URL, date, amount, region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya import fixed_values as fixed
from atalaya.functions.amounts import AMOUNT, parse_amount
from atalaya.functions.dates import at, parse_date_es, parse_date_fmt, spark_format
from atalaya.functions.status import normalize_status
from atalaya.functions.text import compute_once, group_index, rule_extract, stable_key
from atalaya.functions.urls import join_rooted


def normalize_items(items: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """Every item with its normalized fields and a ``reject_reason`` (NULL = good).

    ``rules`` has one row per source: ``fuente_id, url_base, fecha_regex,
    fecha_formato, monto_regex, monto_normaliza, fecha_normaliza,
    region_defecto``. ``items.regex_aplicada`` marks rows whose extractor has
    applied the source's patterns already, so they are applied only once.
    """
    done = F.col("regex_aplicada") if "regex_aplicada" in items.columns else F.lit(False)
    opening = "fecha_apertura" if "fecha_apertura" in items.columns else None
    region = F.col("region") if "region" in items.columns else F.lit(None).cast("string")
    now = at(as_of)

    def given(name: str):
        return F.nullif(F.col(name), F.lit(""))

    raw_date, raw_amount = given("fecha_cierre"), given("monto")
    by_rule = F.coalesce(F.col("fecha_normaliza"), F.lit(False))
    has_format = F.col("fecha_formato").isNotNull()
    amount_rule = F.coalesce(F.col("monto_normaliza"), F.lit(False))

    # What depends on the rule alone is computed once a source, not once an item.
    rules = rules.withColumns(
        {
            "_date_group": group_index(F.col("fecha_regex")),
            "_amount_group": group_index(F.col("monto_regex")),
            "_date_pattern": spark_format(F.col("fecha_formato")),
        }
    )
    texts = compute_once(
        items.join(rules, "fuente_id", "left"),
        _date_text=F.when(done, raw_date).otherwise(
            rule_extract(raw_date, F.col("fecha_regex"), F.col("_date_group"))
        ),
        _amount_text=F.when(done, raw_amount).otherwise(
            rule_extract(raw_amount, F.col("monto_regex"), F.col("_amount_group"))
        ),
    )
    read = compute_once(
        texts,
        _closing=F.when(
            by_rule,
            F.when(
                has_format,
                parse_date_fmt(F.col("_date_text"), F.col("fecha_formato"), F.col("_date_pattern")),
            ),
        ).otherwise(parse_date_es(raw_date)),
        _amount=F.when(amount_rule, parse_amount(F.col("_amount_text"))),
        _status=normalize_status(F.col("estado")),
    )
    no_date = (
        by_rule
        & raw_date.isNotNull()
        & (F.col("_date_text").isNull() | (has_format & F.col("_closing").isNull()))
    )
    no_amount = amount_rule & raw_amount.isNotNull() & F.col("_amount").isNull()
    reason = (
        F.when(given("identificador").isNull(), "sin_identificador")
        .when(given("titulo").isNull(), "sin_titulo")
        .when(given("url_detalle").isNull(), "sin_url")
        .when(no_date, "fecha_invalida")
        .when(F.col("_closing") < now, "expirada")
        .when(no_amount, "monto_invalido")
    )
    opened = (F.col("_status") == fixed.UNKNOWN_STATUS) & (F.col("_closing") >= now)
    carried = [c for c in ("snapshot_id", "pos") if c in items.columns]
    return read.select(
        stable_key(F.col("fuente_id"), F.col("identificador")).alias("id"),
        "fuente_id",
        F.col("identificador").alias("identificador_externo"),
        "titulo",
        "descripcion",
        join_rooted(F.col("url_detalle"), F.col("url_base")).alias("url_detalle"),
        (parse_date_es(F.col(opening)) if opening else F.lit(None).cast("timestamp_ntz")).alias(
            "fecha_apertura"
        ),
        F.col("_closing").alias("fecha_cierre"),
        F.col("_amount").cast(AMOUNT).alias("monto"),
        F.coalesce(F.nullif(region, F.lit("")), F.col("region_defecto")).alias("region"),
        F.when(opened, "ABIERTO").otherwise(F.col("_status")).alias("estado"),
        *carried,
        reason.alias("reject_reason"),
    )


def normalize_calls(items: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """Only the good rows, as calls."""
    return normalize_items(items, rules, as_of).where("reject_reason IS NULL").drop("reject_reason")
