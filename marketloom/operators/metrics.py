"""Curves: drawdowns, daily returns and summaries, by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 365.0


def drawdown_curve(curves: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return curves.withColumn("drawdown", F.try_divide("equity", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1).withColumn("daily", F.try_divide("equity", F.lag("equity").over(w)) - 1)


def summarize(curves: DataFrame, *keys: str) -> DataFrame:
    """total_return, cagr, max_drawdown, sharpe, sortino and calmar of each curve; all 0 for fewer than two rows or a start of 0."""
    semi = F.sqrt(F.avg(F.pow(F.least("daily", F.lit(0.0)), F.lit(2))))
    sums = drawdown_curve(curves, *keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"), F.min("drawdown").alias("dd"),
        F.avg("daily").alias("mean"), F.stddev_samp("daily").alias("std"), semi.alias("semi"),
    )
    fine = (F.col("n") > 1) & (F.col("first") != 0)
    ratio = F.try_divide("last", "first")
    cagr = F.when(ratio > 0, F.pow(ratio, YEAR / (F.col("n") - 1)) - 1).otherwise(F.lit(-1.0))
    zero = lambda x: F.when(fine, F.coalesce(x, F.lit(0.0))).otherwise(F.lit(0.0))
    out = sums.select(
        *keys, zero(ratio - 1).alias("total_return"), zero(cagr).alias("cagr"), zero(F.col("dd")).alias("max_drawdown"),
        zero(F.try_divide("mean", "std") * YEAR**0.5).alias("sharpe"), zero(F.try_divide("mean", "semi") * YEAR**0.5).alias("sortino"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(F.lit(0.0)))


def rescale(curve: DataFrame, start: float) -> DataFrame:
    """The curve scaled so that it starts at a value."""
    first = F.first("equity").over(Window.partitionBy().orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return curve.withColumn("scaled", F.col("equity") / first * start)


def aligned(curves: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the days that all ``n`` curves have."""
    return curves.join(curves.groupBy("date").agg(F.countDistinct(key).alias("k")).where(F.col("k") == n).select("date"), "date", "left_semi")
