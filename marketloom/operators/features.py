"""Leakage-bounded features and labels for all days at once; a day's row reads only prints up to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import CostModel
from ..schemas import ASSET
from .panel import by_days, last_at

V1 = ["ret_7d", "ret_30d", "ret_90d", "vol_30d", "dip_90d", "log_price", "days_since_release", "is_sealed"]
V2 = [*V1, "spread_frac", "mid_gap", "spread_30d_mean", "ret_accel", "drawdown_180d", "vol_ratio", "xs_rank_ret_30d", "days_priced"]


def spread_of_returns(days: int) -> Column:
    """Sample deviation of the returns between prints that both lie in the last ``days`` days; null with fewer than two returns.

    The first print of the frame has no return, since its base lies outside, so
    the frame's prints are gathered (at most one a day) and folded in one pass
    that carries the last print, the number of returns, their mean and their
    squared deviations.
    """
    seen = F.collect_list("market").over(by_days(1 - days, 0))
    begin = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(acc: Column, price: Column) -> Column:
        off = price / acc["last"] - 1 - acc["mean"]  # null at the first print
        n = acc["n"] + F.when(acc["last"].isNull(), 0.0).otherwise(1.0)
        shift = F.coalesce(off / n, F.lit(0.0))
        squares = acc["squares"] + F.coalesce(off * (off - off / n), F.lit(0.0))
        return F.struct(price.alias("last"), n.alias("n"), (acc["mean"] + shift).alias("mean"), squares.alias("squares"))

    return F.aggregate(seen, begin, step, lambda acc: F.when(acc["n"] > 1, F.sqrt(acc["squares"] / (acc["n"] - 1))))


def _with_v1(prices: DataFrame, products: DataFrame) -> DataFrame:
    """All columns of the panel and the first feature set, in one sort by asset and day."""
    out = prices
    for days in (7, 30, 90):
        out = out.withColumn(f"ret_{days}d", F.col("market") / last_at("market", days) - 1)
    out = out.withColumn("vol_30d", spread_of_returns(30)).withColumn("dip_90d", 1 - F.col("market") / F.max("market").over(by_days(-89, 0)))
    meta = products.select("product_id", (F.col("kind") == "sealed").cast("double").alias("is_sealed"), "released_on")
    out = out.join(F.broadcast(meta), "product_id", "left")  # the catalogue: one row a product
    return out.withColumn("log_price", F.ln("market")).withColumn("days_since_release", F.datediff("date", "released_on").cast("double"))


def features_v1(prices: DataFrame, products: DataFrame) -> DataFrame:
    return _with_v1(prices, products).select("date", *ASSET, "market", *V1)


def features_v2(prices: DataFrame, products: DataFrame) -> DataFrame:
    spread = (F.col("market") - F.col("low")) / F.col("market")
    both = _with_v1(prices, products).withColumns({
        "spread_frac": spread,
        "mid_gap": (F.col("market") - F.col("mid")) / F.col("market"),
        "spread_30d_mean": F.avg(spread).over(by_days(-29, 0)),
        "drawdown_180d": 1 - F.col("market") / F.max("market").over(by_days(-179, 0)),
        "vol_7d": spread_of_returns(7),
        "days_priced": F.count("*").over(by_days(None, 0)).cast("double"),
    })
    ranked = Window.partitionBy("date", F.col("ret_30d").isNull()).orderBy("ret_30d")
    ties = F.count("*").over(Window.partitionBy("date", "ret_30d"))
    rank = (F.rank().over(ranked) + (ties - 1) / 2) / F.count("ret_30d").over(Window.partitionBy("date"))
    out = both.withColumn("ret_accel", F.col("ret_7d") - F.col("ret_30d")).withColumn("vol_ratio", F.try_divide("vol_7d", "vol_30d"))
    return out.withColumn("xs_rank_ret_30d", F.when(F.col("ret_30d").isNotNull(), rank)).select("date", *ASSET, "market", "mid", "low", *V2)


def training_days(as_of: str, horizon: int, train: int, stride: int) -> Column:
    """The days that may be trained on as of a day: horizon ago and then each stride, not before ``train`` days ago."""
    day = F.lit(as_of).cast("date")
    return F.transform(F.sequence(F.lit(horizon), F.lit(train), F.lit(stride)), lambda n: F.date_sub(day, n.cast("int")))


def labelled(prices: DataFrame, products: DataFrame, as_of: str, horizon: int, train: int, stride: int, costs: CostModel | None = None) -> DataFrame:
    """Training rows: features and ``label``, the return to the last price within the horizon; net of the round trip with ``costs``.

    Only prints up to ``as_of`` are read, for features and labels alike.
    """
    known = prices.where(F.col("date") <= F.lit(as_of).cast("date"))
    ahead = known.withColumn("ahead", F.last("market").over(by_days(None, horizon))).select("date", *ASSET, "ahead")
    rows = (features_v2 if costs else features_v1)(known, products).where(F.array_contains(training_days(as_of, horizon, train, stride), F.col("date")))
    label = F.col("ahead") / F.col("market") - 1
    if costs:
        label = label - costs.round_trip_fraction(F.col("market"), F.col("mid"), F.col("low"))
    return rows.join(ahead, ["date", *ASSET]).withColumn("label", label).where("label IS NOT NULL").drop("ahead")
