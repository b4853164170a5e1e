"""Product kinds and the transforms of raw documents into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_of(rarity: Column) -> Column:
    """sealed without a rarity, excluded for code cards, else single."""
    return F.when(rarity.isNull(), "sealed").when(F.lower(F.trim(rarity)) == "code card", "excluded").otherwise("single")


def with_kind(products: DataFrame) -> DataFrame:
    return products.withColumn("kind", kind_of(F.col("rarity")))


def prices_frame(raw: DataFrame, day: str) -> DataFrame:
    """Typed price rows from an archive's ``results`` array of price objects."""
    p = F.col("p")
    return raw.select(F.explode("results").alias("p")).select(
        F.lit(day).cast("date").alias("date"), p["productId"].cast("long").alias("product_id"), p["subTypeName"].cast("string").alias("sub_type"),
        *(p[f"{n}Price"].cast("double").alias(n) for n in ("low", "mid", "high", "market")),
    )


def products_frame(raw: DataFrame) -> DataFrame:
    """Typed products from ``results``: the first Rarity among the extended data, the presale's release day, and the kind."""
    p = F.col("p")
    rarity = F.get(F.filter(p["extendedData"], lambda x: x["name"] == "Rarity"), 0)["value"]
    typed = raw.select(F.explode("results").alias("p")).select(
        p["productId"].cast("long").alias("product_id"), p["groupId"].cast("long").alias("group_id"), p["name"].alias("name"), rarity.alias("rarity"),
        F.to_date(F.substring(p["presaleInfo"]["releasedOn"], 1, 10)).alias("released_on"),
    )
    return with_kind(typed).select("product_id", "group_id", "name", "rarity", "kind", "released_on")


def tracked_groups(groups: DataFrame, today: str, since: str = "2024-01-01") -> DataFrame:
    return groups.where(F.col("published_on").between(F.lit(since).cast("date"), F.lit(today).cast("date")))
