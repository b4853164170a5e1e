"""Price panels, products and curves derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import with_kind

BRAND_SQL = """
  SELECT d AS date, product_id, sub_type, min(px) AS low, (min(px) + max(px)) / 2 AS mid, max(px) AS high, max(CASE WHEN rn = 1 THEN px END) AS market
  FROM (SELECT CAST(l_shipdate AS DATE) AS d, CAST(substr(p_brand, 7) AS BIGINT) AS product_id, l_returnflag AS sub_type, l_extendedprice / l_quantity / 1e2 AS px,
               row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), p_brand, l_returnflag
                 ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS rn
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) x
  GROUP BY d, product_id, sub_type"""
PART_SQL = """
  SELECT d AS date, product_id, sub_type, min(px) AS low, (min(px) + max(px)) / 2 AS mid, max(px) AS high, max(CASE WHEN rn = 1 THEN px END) AS market
  FROM (SELECT CAST(l_shipdate AS DATE) AS d, l_partkey AS product_id, l_returnflag AS sub_type, l_extendedprice / l_quantity / 1e2 AS px,
               row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_partkey, l_returnflag
                 ORDER BY l_orderkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS rn
        FROM {lineitem}) x
  GROUP BY d, product_id, sub_type"""
CATALOG_SQL = """
  SELECT product_id, CAST(floor(product_id / 1e1) AS BIGINT) AS group_id, concat('Brand ', product_id) AS name,
         CASE WHEN product_id % 5 = 0 THEN ' Code Card ' WHEN product_id % 2 = 0 THEN 'Rare' END AS rarity,
         date_add(DATE '1994-06-01', CAST(product_id * 45 AS INT)) AS released_on
  FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS product_id FROM {part}) b WHERE product_id % 7 <> 3"""
CURVE_SQL = "SELECT CAST(ts AS DATE) AS date, CAST(sum(CAST(round(value * 1e2) AS BIGINT)) AS DOUBLE) AS equity FROM {events} GROUP BY 1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense long panel: brand by return flag and ship day."""
    return spark.sql(BRAND_SQL, lineitem=_table(spark, sf_dir, "lineitem"), part=_table(spark, sf_dir, "part"))


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse panel: part by return flag and ship day."""
    return spark.sql(PART_SQL, lineitem=_table(spark, sf_dir, "lineitem"))


def days(prices: DataFrame) -> tuple[str, str]:
    """The first and the last day of a panel; of an empty one, a day on which nothing is."""
    first, last = prices.agg(F.min("date"), F.max("date")).first()
    return str(first or "1970-01-01"), str(last or "1970-01-01")


def brand_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the dense panel; some are missing on purpose. One row a brand, so it may be broadcast."""
    return with_kind(spark.sql(CATALOG_SQL, part=_table(spark, sf_dir, "part"))).select("product_id", "group_id", "name", "rarity", "kind", "released_on")


def event_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equity-like curve: daily sums of events in cents."""
    return spark.sql(CURVE_SQL, events=_table(spark, sf_dir, "events"))
