"""The catalogue of known sources: profiles with aliases and canonical URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    """Letters a-z and digits of the lowered name; accented letters drop out."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def list_profiles(profiles: DataFrame) -> DataFrame:
    """Distinct profiles: the first of each key in catalogue order."""
    firsts = profiles.groupBy("key").agg(
        F.min_by(F.struct("ordinal", "root_url", "list_url"), "ordinal").alias("p")
    )
    return firsts.select("key", "p.*").orderBy("ordinal")


def profile_names(profiles: DataFrame) -> DataFrame:
    """One row per name a profile answers to; a name given twice keeps the last."""
    names = F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))
    exploded = profiles.select("*", F.posexplode(names).alias("_pos", "_name")).withColumn(
        "clave", name_key(F.col("_name"))
    )
    return exploded.groupBy("clave").agg(
        F.max_by(
            F.struct("key", "root_url", "list_url"), F.struct("ordinal", "_pos")
        ).alias("p")
    )


def resolve_sources(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sources with their profile; a known source takes the profile's URLs."""
    named = sources.withColumn("clave", name_key(F.col("nombre")))
    return named.join(profile_names(profiles), "clave", "left").select(
        *[c for c in sources.columns if c not in ("url_base", "url_busqueda")],
        F.col("p.key").alias("perfil"),
        F.coalesce("p.root_url", "url_base").alias("url_base"),
        F.coalesce("p.list_url", "url_busqueda").alias("url_busqueda"),
    )
