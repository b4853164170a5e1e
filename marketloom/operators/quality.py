"""Quality gates over a price panel, whose jump rule compares with the last clean day.

The recurrence has a set-based form: in a run of days on which the raw ratio is
out of range and the asset printed the day before, odd days are quarantined and
even ones clean, since a quarantined print is no baseline for the next day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ASSET

#: How many times the last price is a jump, and after how many days without data there is no baseline.
JUMP, GAP_DAYS = 10.0, 7


def with_reason(prices: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """The panel with ``reason``: null_market, nonpositive_market, duplicate, price_jump, or null for clean rows."""
    days = prices.select("date").distinct().withColumn("di", F.row_number().over(Window.orderBy("date")))  # one row a day
    copies = F.count("*").over(Window.partitionBy("date", *ASSET))
    rule = F.when(F.col("market").isNull(), "null_market").when(F.col("market") <= 0, "nonpositive_market").when(copies > 1, "duplicate")
    ruled = prices.join(F.broadcast(days), "date").withColumn("rule", rule)  # days: bounded by the calendar
    own = Window.partitionBy(*ASSET, F.col("rule").isNull()).orderBy("date")
    last = lambda c: F.lag(c).over(own)
    ratio = F.col("market") / F.when(F.col("rule").isNull(), last("market"))
    near = (last("di") == F.col("di") - 1) & (F.datediff("date", last("date")) <= gap_days)
    bad = F.col("rule").isNull() & near & ((ratio > JUMP) | (ratio < 1 / JUMP))
    flagged = ruled.withColumn("bad", F.coalesce(bad, F.lit(False)).cast("int"))
    island = flagged.withColumn("island", F.sum(1 - F.col("bad")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.sum("bad").over(Window.partitionBy(*ASSET, F.col("rule").isNull(), "island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    jump = F.when((F.col("bad") == 1) & (place % 2 == 1), "price_jump")
    return island.withColumn("reason", F.coalesce("rule", jump)).select(*prices.columns, "reason")


def gate(prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined with reason)."""
    told = with_reason(prices)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")
