"""How far results can be trusted: resampled intervals, deflated Sharpe ratios, a check of the best of many.

Draws are rows: each has a generator of its own, seeded by its number, so any task
can make any of them and the result doesn't depend on how they are dealt. A draw
lays stretches of days end to end, of geometric length and from a random day on,
the same days for every series. What a task needs to know are the series, days x
strategies; their number is checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from statistics import NormalDist, variance

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import YEAR, aligned

#: Numbers that every task of a resampling holds, at most; days that curves must share.
MOST_NUMBERS, LEAST_DAYS = 4_000_000, 60
EULER = 0.5772156649015329


def drawn_days(n: int, block: float, seed: int, number: int) -> np.ndarray:
    """The days of one draw of ``n`` days."""
    if n < 2 or block < 1:
        raise ValueError("a bootstrap needs two observations and blocks of 1 or more")
    rng, days, left = np.random.default_rng([seed, number]), [], n
    while left > 0:
        length = min(left, int(rng.geometric(1 / block)))
        days.append(np.arange(length) + rng.integers(n))
        left -= length
    return np.concatenate(days) % n


def draw(series: np.ndarray, block: float, seed: int, number: int) -> np.ndarray:
    """Mean, total return and daily Sharpe ratio of each series (a row each) in one draw."""
    x = series[:, drawn_days(series.shape[1], block, seed, number)]
    mean, spread = x.mean(axis=1), x.std(axis=1, ddof=1)
    return np.stack([mean, np.prod(1 + x, axis=1) - 1, np.divide(mean, spread, out=np.zeros_like(mean), where=spread > 0)], axis=1)


def draw_table(spark: SparkSession, names: list[str], series: np.ndarray, draws: int, block: float, seed: int) -> DataFrame:
    """draw, name, mean, total_return, sharpe; a task makes some hundred draws."""
    if series.size > MOST_NUMBERS:
        raise ValueError(f"{series.size} numbers are too many for every task to hold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                found = draw(series, block, seed, number)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(names), pa.int64()), pa.array(names), *(pa.array(found[:, i]) for i in range(3))], ["draw", "name", "mean", "total_return", "sharpe"])

    return spark.range(0, draws, 1, max(1, draws // 500)).mapInArrow(run, "draw long, name string, mean double, total_return double, sharpe double")


def sharpe(returns: np.ndarray) -> float:
    """The daily ratio; 0 where the returns don't vary."""
    spread = np.std(returns, ddof=1) if len(returns) > 1 else 0.0
    return float(np.mean(returns) / spread) if spread else 0.0


def bootstrap_ci(returns: np.ndarray, metric: str = "total_return", draws: int = 10_000, block: float = 10.0, seed: int = 42, level: float = 0.95) -> tuple[float, float, float]:
    """(point, low, high) of the total return or the annual Sharpe ratio of one series."""
    r = np.asarray(returns, float)
    at, scale, point = (1, 1.0, np.prod(1 + r) - 1) if metric == "total_return" else (2, math.sqrt(YEAR), sharpe(r) * math.sqrt(YEAR))
    found = [scale * draw(r[None, :], block, seed, k)[0, at] for k in range(draws)]
    return float(point), *(float(np.quantile(found, q)) for q in ((1 - level) / 2, (1 + level) / 2))


def best_by_luck(spread: float, trials: int) -> float:
    """The Sharpe ratio to expect of the best of ``trials`` worthless ones that vary by ``spread``."""
    quantile = NormalDist().inv_cdf
    return spread * ((1 - EULER) * quantile(1 - 1 / trials) + EULER * quantile(1 - 1 / (math.e * trials)))


def deflated(days: int, ratio: float, skew: float, kurtosis: float, hurdle: float) -> float | None:
    """The chance that the true ratio is above the hurdle, by its length, skew and (full) kurtosis; None if these can't be."""
    width = 1 - skew * ratio + (kurtosis - 1) * ratio * ratio / 4
    return NormalDist().cdf((ratio - hurdle) * math.sqrt((days - 1) / width)) if width > 0 else None


def deflated_sharpe(returns: np.ndarray, trial_sharpes: Iterable[float]) -> float | None:
    """``deflated`` of one series among trials; None where the series doesn't vary or is too short."""
    trials, r = list(trial_sharpes), np.asarray(returns, float)
    if len(trials) < 2:
        raise ValueError("deflation needs two trials")
    away = r - r.mean() if len(r) else r
    second = (away**2).mean() if len(r) > 2 else 0.0
    if not second:
        return None
    return deflated(len(r), sharpe(r), (away**3).mean() / second**1.5, (away**4).mean() / second**2, best_by_luck(math.sqrt(variance(trials)), len(trials)))


def reality_check(excess: np.ndarray, draws: int = 10_000, block: float = 10.0, seed: int = 42) -> float:
    """The p-value of the best mean excess of several strategies: how often a draw's largest rise above the means is as large."""
    x = np.atleast_2d(np.asarray(excess, float))
    means = x.mean(axis=1)
    rises = np.array([(draw(x, block, seed, k)[:, 0] - means).max() for k in range(draws)])
    return float((rises >= means.max()).mean())


def return_moments(curves: DataFrame, key: str = "strategy") -> DataFrame:
    """By curve: total_return, daily mean, std, sharpe (annual), skew and kurtosis (full) of its returns, n_days, start, end."""
    w = Window.partitionBy(key).orderBy("date")
    r = curves.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    sums = r.groupBy(key).agg(F.max_by("equity", "date").alias("last"), F.min_by("equity", "date").alias("first"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurtosis"), F.count("*").alias("n_days"), F.min("date").alias("start"), F.max("date").alias("end"))
    ratio = F.coalesce(F.try_divide("mean", "std"), F.lit(0.0))
    return sums.select(key, (F.col("last") / F.col("first") - 1).alias("total_return"), "mean", "std", (ratio * YEAR**0.5).alias("sharpe"), "skew", "kurtosis", "n_days", "start", "end")


def evaluate(curves: DataFrame, benchmark: DataFrame, draws: int = 10_000, block: float = 10.0, seed: int = 42, level: float = 0.95) -> DataFrame:
    """A row a strategy over the days that all ``curves`` (strategy, date, equity) and the ``benchmark`` (date, equity) share.

    strategy, total_return, low, high, sharpe, deflated, reality_p, n_days, start,
    end. ValueError for fewer than two strategies or 60 shared days.
    """
    spark, own = curves.sparkSession, "\0benchmark"
    both = curves.select("strategy", "date", "equity").unionByName(benchmark.select(F.lit(own).alias("strategy"), "date", "equity"))
    names = sorted(r["strategy"] for r in curves.select("strategy").distinct().collect())
    if len(names) < 2:
        raise ValueError(f"a check of the best needs two strategies, not {len(names)}")
    shared = aligned(both, "strategy", len(names) + 1)
    rows = {r["strategy"]: r for r in return_moments(shared).collect()}
    n_days = rows[own]["n_days"] if own in rows else 0
    if n_days < LEAST_DAYS:
        raise ValueError(f"the curves share {n_days} days; {LEAST_DAYS} are needed")
    if n_days * (len(names) + 1) > MOST_NUMBERS:
        raise ValueError(f"{n_days} days of {len(names)} curves are too many for every task to hold")
    w = Window.partitionBy("strategy").orderBy("date")
    daily = shared.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1).where("r IS NOT NULL").orderBy("strategy", "date").select("strategy", "r").toPandas()
    of = {name: part["r"].to_numpy() for name, part in daily.groupby("strategy")}
    series = np.stack([of[n] for n in names])
    bounds = [(1 - level) / 2, (1 + level) / 2]
    spans = draw_table(spark, names, series, draws, block, seed).groupBy(F.col("name").alias("strategy")).agg(F.percentile("total_return", bounds[0]).alias("low"), F.percentile("total_return", bounds[1]).alias("high"))
    excess = series - of[own]
    means = spark.createDataFrame([(n, float(m)) for n, m in zip(names, excess.mean(axis=1), strict=True)], "name string, seen double")
    rises = draw_table(spark, names, excess, draws, block, seed).join(F.broadcast(means), "name").groupBy("draw").agg(F.max(F.col("mean") - F.col("seen")).alias("rise"))  # a row a strategy
    p = rises.agg(F.avg((F.col("rise") >= F.lit(float(excess.mean(axis=1).max()))).cast("double")).alias("reality_p"))
    ratios = {n: rows[n]["sharpe"] / YEAR**0.5 for n in names}
    hurdle = best_by_luck(math.sqrt(variance(ratios.values())), len(names))
    chances = [(n, deflated(n_days - 1, ratios[n], rows[n]["skew"], rows[n]["kurtosis"], hurdle) if rows[n]["std"] else None) for n in names]
    told = spark.createDataFrame([(n, rows[n]["total_return"], rows[n]["sharpe"], c, n_days, rows[n]["start"], rows[n]["end"]) for n, c in chances], "strategy string, total_return double, sharpe double, deflated double, n_days long, start date, end date")
    return told.join(spans, "strategy").crossJoin(F.broadcast(p)).select("strategy", "total_return", "low", "high", "sharpe", "deflated", "reality_p", "n_days", "start", "end")
