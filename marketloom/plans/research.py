"""Folds, search, walk-forward and stitching."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import summarize
from .rigor import bootstrap_ci, deflated_sharpe, reality_check, sharpe  # noqa: F401
from .simulate import RUNS, backtest, curves_of
from .strategies import PARAMS, resolve

FOLDS = "fold INT, is_start DATE, is_end DATE, oos_start DATE, oos_end DATE"
OBJECTIVES = ("total_return", "cagr", "max_drawdown", "sharpe", "sortino", "calmar")


def make_folds(spark: SparkSession, start: str, end: str, is_days: int, oos_days: int) -> DataFrame:
    """Windows that step by ``oos_days``, as long as the out-of-sample part ends in time."""
    if is_days < 1 or oos_days < 1:
        raise ValueError("folds need days on both sides")
    s, day = F.lit(start).cast("date"), F.col("id").cast("int") * oos_days
    span = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
    n = max(0, (span - is_days) // oos_days)
    add = lambda d: F.date_add(s, d)
    return spark.range(n).select(F.col("id").cast("int").alias("fold"), add(day).alias("is_start"), add(day + is_days - 1).alias("is_end"), add(day + is_days).alias("oos_start"), add(day + is_days + oos_days - 1).alias("oos_end"))


def sample_params(name: str, seed: int, n: int) -> list[dict]:
    """``n`` settings, stratified in each parameter's range, from a seed; the defaults first."""
    out = [resolve(name, {})]
    rnd = random.Random(f"{name}/{seed}")
    columns = {}
    for p in PARAMS[name]:
        if p.kind is str:
            continue
        strata = list(range(max(1, n - 1)))
        rnd.shuffle(strata)
        u = [(k + rnd.random()) / len(strata) for k in strata]
        columns[p.name] = [math.exp(math.log(p.low) + x * math.log(p.high / p.low)) if p.log else p.low + x * (p.high - p.low) for x in u]
    return out + [resolve(name, {k: v[i] for k, v in columns.items()}) for i in range(n - 1)]


def walk_forward(prices: DataFrame, products: DataFrame, strategy: str, start: str, end: str, is_days: int = 180, oos_days: int = 60, trials: int = 25, seed: int = 42, warmup: int = 120, cash: float = 10_000.0, objective: str = "total_return", impact: bool = True) -> dict[str, DataFrame]:
    """``best`` (fold, params, in-sample score), ``oos`` summaries and ``curve`` (stitched).

    Trials of all folds are one job of independent runs; the best of each fold,
    ties to the earlier trial, run out of sample in a second job.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"the objective is one of {', '.join(OBJECTIVES)}")
    spark = prices.sparkSession
    folds = make_folds(spark, start, end, is_days, oos_days)
    settings = spark.createDataFrame([(k, json.dumps(p, sort_keys=True)) for k, p in enumerate(sample_params(strategy, seed, trials))], "trial INT, params STRING")
    plan = folds.join(F.broadcast(settings)).withColumn("run_id", F.format_string("%05d/%05d", "fold", "trial"))  # a plan of folds x trials runs
    common = [F.lit(strategy).alias("strategy"), "params"]
    rest = [F.lit(warmup).alias("warmup"), F.lit(cash).alias("cash"), F.lit(impact).alias("impact")]
    tried = backtest(prices, products, plan.select("run_id", *common, F.col("is_start").alias("start"), F.col("is_end").alias("end"), *rest))
    scores = summarize(curves_of(tried), "run_id").select("run_id", F.col(objective).alias("score"))
    ranked = plan.join(scores, "run_id").withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("score"), "trial")))
    best = ranked.where("place = 1").select("fold", "params", "oos_start", "oos_end", F.col("score").alias("is_score")).cache()
    oos = backtest(prices, products, best.select(F.format_string("%05d", "fold").alias("run_id"), *common, F.col("oos_start").alias("start"), F.col("oos_end").alias("end"), *rest))
    curves = curves_of(oos).cache()
    return {"best": best, "oos": summarize(curves, "run_id"), "curve": stitch(curves)}


def summarize_folds(in_sample: DataFrame, out_of_sample: DataFrame) -> DataFrame:
    """Means over folds of each side's summaries (fold, total_return, cagr, max_drawdown, sharpe), how many folds there are, and the gap of the two sides' growth."""
    sides = [df.agg(*(F.avg(c).alias(f"{side}_{c}") for c in ("total_return", "cagr", "max_drawdown", "sharpe")), F.count("*").alias(f"{side}_folds")) for side, df in (("is", in_sample), ("oos", out_of_sample))]
    return sides[0].crossJoin(F.broadcast(sides[1])).withColumn("overfitting_gap", F.col("is_cagr") - F.col("oos_cagr"))  # a row each


def spearman(scored: DataFrame, predicted: str, label: str) -> DataFrame:
    """date and the rank correlation of two columns on that day, ties at their mean rank; days of fewer than three rows, or without spread, are left out."""

    def rank(column: str):
        same = Window.partitionBy("date", column)
        return F.rank().over(Window.partitionBy("date").orderBy(column)) + (F.count("*").over(same) - 1) / 2

    ranked = scored.where(F.col(predicted).isNotNull() & F.col(label).isNotNull()).select("date", rank(predicted).alias("a"), rank(label).alias("b"))
    sums = ranked.groupBy("date").agg(F.count("*").alias("n"), F.covar_pop("a", "b").alias("both"), (F.stddev_pop("a") * F.stddev_pop("b")).alias("spread"))
    return sums.withColumn("spearman", F.try_divide("both", "spread")).where("n >= 3 AND spearman IS NOT NULL").select("date", "spearman")


def stitch(curves: DataFrame) -> DataFrame:
    """Out-of-sample curves chained: each is rescaled to begin at the level where the last ended. run_ids order the folds."""
    bounds = curves.groupBy("run_id").agg(F.min_by("equity", "date").alias("base"), F.max_by("equity", "date").alias("end"))
    before = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a fold
    level = F.aggregate(F.collect_list(F.struct("base", "end")).over(before), F.lit(1.0), lambda acc, x: acc * x["end"] / x["base"])
    first = F.first("base").over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0))
    levels = bounds.select("run_id", "base", (level * first).alias("level"))
    return curves.join(F.broadcast(levels), "run_id").select("run_id", "date", (F.col("level") * F.col("equity") / F.col("base")).alias("equity"))


def purged_split(days: list[dt.date], horizon: int, share: float = 0.15) -> tuple[list[dt.date], list[dt.date]]:
    """(train, validation): the last share of the days validates, and training days end a horizon before them."""
    days = sorted(set(days))
    if not days:
        return [], []
    held = days[-max(1, round(share * len(days))) :]
    return [d for d in days if d <= held[0] - dt.timedelta(horizon)], held


def one_run(spark: SparkSession, strategy: str, start: str, end: str, cash: float = 10_000.0, warmup: int = 120, impact: bool = True, **params) -> DataFrame:
    """A plan of a single run."""
    row = (strategy, strategy, json.dumps(resolve(strategy, params)), dt.date.fromisoformat(start), dt.date.fromisoformat(end), warmup, cash, impact)
    return spark.createDataFrame([row], RUNS)
