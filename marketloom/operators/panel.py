"""Marks, as-of lookups and window signals over a price panel; each takes one sort by asset and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ASSET

DAY = 86_400


def by_asset() -> Window:
    return Window.partitionBy(*ASSET).orderBy("date")


def by_days(first: int | None, last: int) -> Window:
    """A frame of calendar days relative to the row; ``first`` None: from the beginning."""
    ordered = Window.partitionBy(*ASSET).orderBy(F.unix_date("date"))
    return ordered.rangeBetween(Window.unboundedPreceding if first is None else first, last)


def slice_window(prices: DataFrame, start: str, end: str, warmup: int = 0) -> DataFrame:
    return prices.where(F.col("date").between(F.date_sub(F.lit(start).cast("date"), warmup), F.lit(end).cast("date")))


def change_points(prices: DataFrame) -> DataFrame:
    """The prints whose market differs from the asset's last print."""
    last = F.lag("market").over(by_asset())
    return prices.withColumn("last", last).where("last IS NULL OR market <> last").select("date", *ASSET, "market")


def marks(prices: DataFrame) -> DataFrame:
    """Every trading day by every asset ever seen by then: the last print at or before the day, and whether it printed."""
    days, assets = prices.select("date").distinct(), prices.select(*ASSET).distinct()
    grid = assets.join(F.broadcast(days))  # days: bounded by the calendar; the grid is the panel's own size, not a pairing of rows
    dense = grid.join(prices.select("date", *ASSET, "market", "low", "mid"), ["date", *ASSET], "left")
    mark = F.last("market", ignorenulls=True).over(by_asset().rowsBetween(Window.unboundedPreceding, 0))
    return dense.withColumn("mark", mark).where("mark IS NOT NULL").withColumn("printed", F.col("market").isNotNull())


def last_at(column: str, days: int) -> Column:
    """The value of the last row at least so many days ago."""
    return F.last(column, ignorenulls=True).over(by_days(None, -days))


def as_of(left: DataFrame, right: DataFrame, value: str, left_day: str = "date", right_day: str = "date") -> DataFrame:
    """Backward as-of join by asset without a range join: both sides in one ordered pass, right rows before left rows of a day."""
    r = right.select(*ASSET, F.col(right_day).alias("_day"), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    kept = F.struct(*(F.col(c) for c in left.columns))
    l = left.select(*ASSET, F.col(left_day).alias("_day"), kept.alias("_row"), F.lit(1).alias("_side"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*ASSET).orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_found", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_found").alias(f"{value}_as_of"))


def top_ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(*order, *ASSET))).where(F.col("rank") <= k)
