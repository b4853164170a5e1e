"""The queries over the engine's own operators, each with the SQL it should equal.

Queries whose result depends on the sequential fold or on numpy's generator have
no SQL; tests hold them against hand-worked cases.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.costs import CostModel
from .operators import features, metrics, panel, quality
from .plans import live, research, rigor
from .plans.simulate import backtest, curves_of, fills_of
from .schemas import ASSET
from .sources import panels

BRAND = panels.BRAND_SQL.format(lineitem="lineitem", part="part")
PART = panels.PART_SQL.format(lineitem="lineitem")
CURVE = panels.CURVE_SQL.format(events="events")
CATALOG = f"""SELECT *, CASE WHEN rarity IS NULL THEN 'sealed' WHEN lower(trim(rarity)) = 'code card' THEN 'excluded' ELSE 'single' END AS kind FROM (
  SELECT product_id, CAST(floor(product_id / 1e1) AS BIGINT) AS group_id, concat('Brand ', product_id) AS name,
         CASE WHEN product_id % 5 = 0 THEN ' Code Card ' WHEN product_id % 2 = 0 THEN 'Rare' END AS rarity,
         DATE '1994-06-01' + CAST(product_id * 45 AS INT) AS released_on
  FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS product_id FROM part) b WHERE product_id % 7 <> 3)"""
WITH = f"WITH prices AS ({BRAND}), products AS ({CATALOG})"
START, END = "1996-01-01", "1996-12-31"
OVER = "PARTITION BY product_id, sub_type ORDER BY date"

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def keep(fn: Query) -> Query:
        _FOUND[fn.__name__] = (fn, sql)
        return fn

    return keep


def queries() -> dict[str, Query]:
    return {k: fn for k, (fn, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- sources, classification, gates ---------------------------------------------------------------


@query(f"WITH products AS ({CATALOG}) SELECT product_id, group_id, name, rarity, kind, released_on FROM products")
def kind_classify(spark, sf):
    return panels.brand_products(spark, sf)


@query(f"{WITH} SELECT date, product_id, sub_type, low, mid, high, market FROM prices WHERE date BETWEEN DATE '{START}' - 120 AND DATE '{END}'")
def panel_window(spark, sf):
    return panel.slice_window(panels.brand_prices(spark, sf), START, END, 120)


_GATE = f"""{WITH}, idx AS (SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM prices) x),
j AS (SELECT p.*, i.di, lag(p.market) OVER w AS pm, lag(i.di) OVER w AS pdi, lag(p.date) OVER w AS pd FROM prices p JOIN idx i ON p.date = i.date WINDOW w AS (PARTITION BY product_id, sub_type ORDER BY p.date)),
b AS (SELECT *, CASE WHEN pdi = di - 1 AND date_diff('day', pd, date) <= 7 AND (market / pm > 10 OR market / pm < 1 / 1e1) THEN 1 ELSE 0 END AS bad FROM j),
g AS (SELECT *, sum(1 - bad) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS isl FROM b),
h AS (SELECT *, sum(bad) OVER (PARTITION BY product_id, sub_type, isl ORDER BY date ROWS UNBOUNDED PRECEDING) AS pos FROM g),
told AS (SELECT date, product_id, sub_type, market, CASE WHEN bad = 1 AND pos % 2 = 1 THEN 'price_jump' END AS reason FROM h)"""


@query(f"{_GATE} SELECT * FROM told")
def quality_gate(spark, sf):
    return quality.with_reason(panels.brand_prices(spark, sf)).select("date", *ASSET, "market", "reason")


@query(f"{_GATE} SELECT coalesce(reason, 'clean') AS reason, count(*) AS n FROM told GROUP BY 1")
def gate_reason_counts(spark, sf):
    return quality.with_reason(panels.brand_prices(spark, sf)).groupBy(F.coalesce("reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT min(date) AS first, max(date) AS last, count(*) AS n FROM prices")
def data_fingerprint(spark, sf):
    return panels.brand_prices(spark, sf).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


@query(f"{WITH} SELECT product_id, count(*) AS n FROM prices WHERE product_id NOT IN (SELECT product_id FROM products) GROUP BY 1")
def catalog_gaps(spark, sf):
    return panels.brand_prices(spark, sf).join(panels.brand_products(spark, sf), "product_id", "left_anti").groupBy("product_id").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT a.product_id, a.sub_type, dense_rank() OVER (ORDER BY a.product_id, a.sub_type) - 1 AS asset_id, CASE coalesce(kind, 'other') WHEN 'sealed' THEN 0 WHEN 'single' THEN 1 ELSE -1 END AS kind_code, coalesce(name, concat('product ', a.product_id)) AS name FROM (SELECT DISTINCT product_id, sub_type FROM prices) a LEFT JOIN products USING (product_id)")
def asset_dictionary(spark, sf):
    assets = panels.brand_prices(spark, sf).select(*ASSET).distinct().join(F.broadcast(panels.brand_products(spark, sf)), "product_id", "left")
    code = F.when(F.col("kind") == "sealed", 0).when(F.col("kind") == "single", 1).otherwise(-1)
    return assets.select(*ASSET, (F.dense_rank().over(Window.orderBy(*ASSET)) - 1).alias("asset_id"), code.alias("kind_code"), F.coalesce("name", F.concat(F.lit("product "), "product_id")).alias("name"))


@query(f"{WITH} SELECT date, max(CASE WHEN sub_type = 'A' THEN market END) AS A, max(CASE WHEN sub_type = 'N' THEN market END) AS N, max(CASE WHEN sub_type = 'R' THEN market END) AS R FROM prices WHERE product_id = 11 GROUP BY date")
def pivot_subtype(spark, sf):
    return panels.brand_prices(spark, sf).where("product_id = 11").groupBy("date").pivot("sub_type", ["A", "N", "R"]).agg(F.first("market"))


@query(f"{WITH} SELECT coalesce(kind, 'other') AS kind, sub_type, count(*) AS n, count(DISTINCT prices.product_id) AS products, round(max(market), 6) AS top FROM prices LEFT JOIN products USING (product_id) GROUP BY GROUPING SETS ((coalesce(kind, 'other'), sub_type), (coalesce(kind, 'other')), ())")
def warehouse_sql(spark, sf):
    """Any SQL over the views; here grouping sets over a left join."""
    sql = "SELECT kind, sub_type, count(*) AS n, count(DISTINCT product_id) AS products, round(max(market), 6) AS top FROM (SELECT coalesce(kind, 'other') AS kind, sub_type, p.product_id, market FROM {prices} p LEFT JOIN {products} c ON p.product_id = c.product_id) GROUP BY GROUPING SETS ((kind, sub_type), (kind), ())"
    return spark.sql(sql, prices=panels.brand_prices(spark, sf), products=panels.brand_products(spark, sf))


# --- marks and windows ----------------------------------------------------------------------------


@query(f"{WITH}, g AS (SELECT * FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT product_id, sub_type FROM prices) a), m AS (SELECT g.*, last_value(market IGNORE NULLS) OVER (PARTITION BY g.product_id, g.sub_type ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS mark, market IS NOT NULL AS printed FROM g LEFT JOIN prices USING (date, product_id, sub_type)) SELECT * FROM m WHERE mark IS NOT NULL")
def marks_carry_forward(spark, sf):
    return panel.marks(panels.brand_prices(spark, sf)).select("date", *ASSET, "mark", "printed")


@query(f"{WITH} SELECT date, product_id, sub_type, market FROM (SELECT *, lag(market) OVER ({OVER}) AS last FROM prices) x WHERE last IS NULL OR market <> last")
def change_points(spark, sf):
    return panel.change_points(panels.brand_prices(spark, sf))


@query(f"WITH prices AS ({PART}) SELECT date, product_id, sub_type, market, last_value(market) OVER ({OVER} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 90 DAY PRECEDING) AS market_as_of FROM prices")
def last_price_asof(spark, sf):
    prices = panels.part_prices(spark, sf)
    left = prices.select("date", *ASSET, "market", F.date_sub("date", 90).alias("at"))
    return panel.as_of(left, prices, "market", left_day="at").drop("at")


@query(f"{WITH} SELECT date, product_id, sub_type, market / last_value(market) OVER ({OVER} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) - 1 AS ret_7d, market / last_value(market) OVER ({OVER} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAY PRECEDING) - 1 AS ret_30d, 1 - market / max(market) OVER ({OVER} RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS dip_90d, 1 - market / max(market) OVER ({OVER} RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW) AS drawdown_180d, max(market) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS peak, count(*) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS days_priced FROM prices")
def window_signals(spark, sf):
    ret = lambda d: (F.col("market") / panel.last_at("market", d) - 1).alias(f"ret_{d}d")
    high = lambda d: F.max("market").over(panel.by_days(1 - d, 0))
    everything = panel.by_days(None, 0)
    return panels.brand_prices(spark, sf).select("date", *ASSET, ret(7), ret(30), (1 - F.col("market") / high(90)).alias("dip_90d"), (1 - F.col("market") / high(180)).alias("drawdown_180d"), F.max("market").over(everything).alias("peak"), F.count("*").over(everything).alias("days_priced"))


_VOL = "SELECT a.date, a.product_id, a.sub_type, stddev_samp(r) AS vol FROM (SELECT a.date, a.product_id, a.sub_type, b.market / lag(b.market) OVER (PARTITION BY a.date, a.product_id, a.sub_type ORDER BY b.date) - 1 AS r FROM prices a JOIN prices b ON a.product_id = b.product_id AND a.sub_type = b.sub_type AND b.date <= a.date AND b.date > a.date - {days}) a GROUP BY ALL"
_F1 = f"""{WITH}, vol AS ({_VOL.format(days=30)}), v1 AS (SELECT p.date, p.product_id, p.sub_type, market,
  market / last_value(market) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) - 1 AS ret_7d, market / last_value(market) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAY PRECEDING) - 1 AS ret_30d,
  market / last_value(market) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 90 DAY PRECEDING) - 1 AS ret_90d, round(vol, 6) AS vol_30d, 1 - market / max(market) OVER (w RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS dip_90d,
  round(ln(market), 6) AS log_price, CAST(date_diff('day', released_on, p.date) AS DOUBLE) AS days_since_release, CAST(kind = 'sealed' AS DOUBLE) AS is_sealed
  FROM prices p LEFT JOIN vol USING (date, product_id, sub_type) LEFT JOIN products c ON p.product_id = c.product_id WINDOW w AS (PARTITION BY p.product_id, p.sub_type ORDER BY p.date))"""
_F1 = _F1.replace("(w RANGE", "(PARTITION BY p.product_id, p.sub_type ORDER BY p.date RANGE").replace(" WINDOW w AS (PARTITION BY p.product_id, p.sub_type ORDER BY p.date)", "")


@query(f"{_F1} SELECT * FROM v1")
def features_v1(spark, sf):
    return rounded(features.features_v1(panels.brand_prices(spark, sf), panels.brand_products(spark, sf)), "vol_30d", "log_price")


@query(f"""{_F1}, vol7 AS ({_VOL.format(days=7)}), own AS (SELECT date, product_id, sub_type, mid, low, (market - low) / market AS spread_frac, (market - mid) / market AS mid_gap,
  round(avg((market - low) / market) OVER ({OVER} RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW), 6) AS spread_30d_mean, 1 - market / max(market) OVER ({OVER} RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW) AS drawdown_180d,
  CAST(count(*) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS days_priced FROM prices)
SELECT v1.*, own.mid, own.low, spread_frac, mid_gap, spread_30d_mean, ret_7d - ret_30d AS ret_accel, drawdown_180d, round(vol7.vol / nullif(vol.vol, 0), 4) AS vol_ratio,
  CASE WHEN ret_30d IS NOT NULL THEN (rank() OVER (PARTITION BY date, ret_30d IS NULL ORDER BY ret_30d) + (count(*) OVER (PARTITION BY date, ret_30d) - 1) / 2e0) / count(ret_30d) OVER (PARTITION BY date) END AS xs_rank_ret_30d, days_priced
FROM v1 JOIN own USING (date, product_id, sub_type) JOIN vol USING (date, product_id, sub_type) JOIN vol7 USING (date, product_id, sub_type)""")
def features_v2(spark, sf):
    return rounded(rounded(features.features_v2(panels.brand_prices(spark, sf), panels.brand_products(spark, sf)), "vol_30d", "log_price", "spread_30d_mean"), "vol_ratio", places=4)


_LABEL = f"""{WITH}, known AS (SELECT * FROM prices WHERE date <= DATE '1997-06-30'), ahead AS (SELECT *, last_value(market) OVER ({OVER} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAY FOLLOWING) AS ahead FROM known),
days AS (SELECT DATE '1997-06-30' - CAST(n AS INT) AS date FROM range(30, 366, 30) r(n))"""
_CAP = "CASE WHEN market < 5 THEN 20 WHEN market < 50 THEN 8 WHEN market < 200 THEN 3 ELSE 1 END"
_COST = f"(2 * 1e0 + market * 0.1275::DOUBLE + (CASE WHEN mid - market > 0 THEN (mid - market) / (2 * {_CAP}) ELSE 0e0 END + CASE WHEN market - low > 0 THEN (market - low) / (2 * {_CAP}) ELSE 0e0 END)) / market"


@query(f"{_LABEL} SELECT date, product_id, sub_type, market, ahead / market - 1 AS label FROM ahead JOIN days USING (date)")
def training_labels(spark, sf):
    return features.labelled(panels.brand_prices(spark, sf), panels.brand_products(spark, sf), "1997-06-30", 30, 365, 30).select("date", *ASSET, "market", "label")


@query(f"{_LABEL} SELECT date, product_id, sub_type, market, round(ahead / market - 1 - {_COST}, 9) AS label FROM ahead JOIN days USING (date)")
def net_labels(spark, sf):
    rows = features.labelled(panels.brand_prices(spark, sf), panels.brand_products(spark, sf), "1997-06-30", 30, 365, 30, CostModel(impact=True))
    return rounded(rows.select("date", *ASSET, "market", "label"), "label", places=9)


# --- costs ------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT date, product_id, sub_type, {_CAP} AS cap, 3 * market + 1e0 AS buy_total, 3 * market * (1 - 0.1275::DOUBLE) - 1e0 AS sell_total, CASE WHEN mid - market > 0 THEN (mid - market) * 2 * (2 * 1 + 2) / (2 * {_CAP}) ELSE 0e0 END AS buy_impact, CASE WHEN market - low > 0 THEN (market - low) * 2 * (2 * 1 + 2) / (2 * {_CAP}) ELSE 0e0 END AS sell_impact FROM prices")
def trading_costs(spark, sf):
    costs, m = CostModel(impact=True), F.col("market")
    move = lambda spread: costs.impact_column(spread, m, F.lit(2), F.lit(1))
    return panels.brand_prices(spark, sf).select("date", *ASSET, costs.cap_column(m).alias("cap"), costs.buy_total(m, F.lit(3)).alias("buy_total"), costs.sell_total(m, F.lit(3)).alias("sell_total"), move(F.col("mid") - m).alias("buy_impact"), move(m - F.col("low")).alias("sell_impact"))


@query(f"{WITH} SELECT date, product_id, sub_type, round({_COST}, 9) AS cost_frac FROM prices")
def round_trip_cost(spark, sf):
    cost = CostModel(impact=True).round_trip_fraction(F.col("market"), F.col("mid"), F.col("low"))
    return panels.brand_prices(spark, sf).select("date", *ASSET, F.round(cost, 9).alias("cost_frac"))


# --- strategy candidates ----------------------------------------------------------------------------

_MARKS = f"{WITH}, g AS (SELECT * FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT product_id, sub_type FROM prices) a), f AS (SELECT g.*, last_value(market IGNORE NULLS) OVER (PARTITION BY g.product_id, g.sub_type ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS mark FROM g LEFT JOIN prices USING (date, product_id, sub_type)), m AS (SELECT f.*, kind, released_on FROM f LEFT JOIN products USING (product_id) WHERE mark IS NOT NULL)"


def _dense(spark, sf):
    return panel.marks(panels.brand_prices(spark, sf)).join(F.broadcast(panels.brand_products(spark, sf).select("product_id", "kind", "released_on")), "product_id", "left")


@query(f"{_MARKS} SELECT * FROM (SELECT date, product_id, sub_type, mark, fall, row_number() OVER (PARTITION BY date ORDER BY fall DESC, product_id, sub_type) AS rank FROM (SELECT *, 1 - mark / max(mark) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS fall FROM m) x WHERE kind = 'sealed' AND date_diff('day', released_on, date) BETWEEN 60 AND 365 AND fall >= 0.25::DOUBLE) WHERE rank <= 10")
def sealed_candidates(spark, sf):
    fell = _dense(spark, sf).withColumn("fall", 1 - F.col("mark") / F.max("mark").over(panel.by_asset().rowsBetween(Window.unboundedPreceding, 0)))
    fit = fell.where((F.col("kind") == "sealed") & F.datediff("date", "released_on").between(60, 365) & (F.col("fall") >= 0.25))
    return panel.top_ranked(fit, 10, F.desc("fall")).select("date", *ASSET, "mark", "fall", "rank")


def _ranked_returns(days: int, descending: bool, rule: str) -> str:
    return f"{_MARKS} SELECT * FROM (SELECT date, product_id, sub_type, mark, ret, row_number() OVER (PARTITION BY date ORDER BY ret {'DESC' if descending else ''}, product_id, sub_type) AS rank FROM (SELECT *, mark / last_value(mark) OVER ({OVER} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days} DAY PRECEDING) - 1 AS ret FROM m) x WHERE kind = 'single' AND mark >= 3 AND {rule}) WHERE rank <= 10"


@query(_ranked_returns(7, False, "ret <= -0.3::DOUBLE"))
def dip_candidates(spark, sf):
    back = _dense(spark, sf).withColumn("ret", F.col("mark") / panel.last_at("mark", 7) - 1)
    return panel.top_ranked(back.where("kind = 'single' AND mark >= 3 AND ret <= -0.3D"), 10, F.asc("ret")).select("date", *ASSET, "mark", "ret", "rank")


@query(_ranked_returns(60, True, "ret IS NOT NULL"))
def momentum_topn(spark, sf):
    back = _dense(spark, sf).withColumn("ret", F.col("mark") / panel.last_at("mark", 60) - 1)
    return panel.top_ranked(back.where("kind = 'single' AND mark >= 3 AND ret IS NOT NULL"), 10, F.desc("ret")).select("date", *ASSET, "mark", "ret", "rank")


@query(f"{_MARKS} SELECT * FROM (SELECT date, product_id, sub_type, mark, high, row_number() OVER (PARTITION BY date ORDER BY 1 - mark / high DESC, product_id, sub_type) AS rank FROM (SELECT *, max(mark) OVER ({OVER} RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS high FROM m) x WHERE mark >= 3 AND 1 - mark / high >= 0.25::DOUBLE AND high / mark - 1 >= 0.1275::DOUBLE + 2 / mark + 0.05::DOUBLE) WHERE rank <= 10")
def reversion_candidates(spark, sf):
    high = _dense(spark, sf).withColumn("high", F.max("mark").over(panel.by_days(-30, 0)))
    fit = high.where("mark >= 3 AND 1 - mark / high >= 0.25D AND high / mark - 1 >= 0.1275D + 2 / mark + 0.05D")
    return panel.top_ranked(fit, 10, F.desc(1 - F.col("mark") / F.col("high"))).select("date", *ASSET, "mark", "high", "rank")


@query(f"{WITH}, day0 AS (SELECT p.* FROM prices p JOIN products USING (product_id) WHERE kind = 'sealed' AND date = (SELECT min(date) FROM prices)) SELECT product_id, sub_type, CAST(floor(1e4 / count(*) OVER () / market) AS BIGINT) AS quantity FROM day0")
def bh_initial_orders(spark, sf):
    prices = panels.brand_prices(spark, sf)
    first = prices.join(F.broadcast(prices.agg(F.min("date").alias("date"))), "date").join(F.broadcast(panels.brand_products(spark, sf).where("kind = 'sealed'").select("product_id")), "product_id")
    share = F.lit(1e4) / F.count("*").over(Window.partitionBy("date"))
    return first.select(*ASSET, F.floor(share / F.col("market")).cast("long").alias("quantity"))


# --- curves and folds -------------------------------------------------------------------------------

_DD = f"WITH c AS ({CURVE}), d AS (SELECT *, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown, equity / nullif(lag(equity) OVER (ORDER BY date), 0) - 1 AS daily FROM c)"


def _curve(spark, sf):
    return panels.event_curve(spark, sf).withColumn("run_id", F.lit("events"))


@query(f"{_DD} SELECT date, equity, drawdown, daily FROM d")
def drawdown_curve(spark, sf):
    return metrics.drawdown_curve(_curve(spark, sf), "run_id").drop("run_id")


@query(f"{_DD}, s AS (SELECT count(*) AS n, arg_max(equity, date) / arg_min(equity, date) AS ratio, min(drawdown) AS dd, avg(daily) AS mean, stddev_samp(daily) AS std, sqrt(avg(least(daily, 0) ** 2)) AS down FROM d) SELECT round(ratio - 1, 6) AS total_return, round(ratio ** (365e0 / (n - 1)) - 1, 6) AS cagr, round(dd, 6) AS max_drawdown, round(mean / std * sqrt(365), 6) AS sharpe, round(mean / down * sqrt(365), 6) AS sortino, round((ratio ** (365e0 / (n - 1)) - 1) / abs(dd), 6) AS calmar FROM s")
def equity_metrics(spark, sf):
    return rounded(metrics.summarize(_curve(spark, sf), "run_id").drop("run_id"), "total_return", "cagr", "max_drawdown", "sharpe", "sortino", "calmar")


@query(f"WITH c AS ({CURVE}) SELECT date, equity, equity / first_value(equity) OVER (ORDER BY date) * 1e4 AS scaled FROM c")
def benchmark_rescale(spark, sf):
    return metrics.rescale(panels.event_curve(spark, sf), 1e4)


_FOLDS = "folds AS (SELECT CAST(k AS INT) AS fold, DATE '1995-01-02' + CAST(k * 60 AS INT) AS is_start, DATE '1995-01-02' + CAST(k * 60 + 179 AS INT) AS is_end, DATE '1995-01-02' + CAST(k * 60 + 180 AS INT) AS oos_start, DATE '1995-01-02' + CAST(k * 60 + 239 AS INT) AS oos_end FROM range(100) r(k) WHERE DATE '1995-01-02' + CAST(k * 60 + 239 AS INT) <= DATE '1997-12-31')"


@query(f"WITH {_FOLDS} SELECT * FROM folds")
def folds(spark, sf):
    return research.make_folds(spark, "1995-01-02", "1997-12-31", 180, 60)


@query(f"{WITH}, {_FOLDS} SELECT fold, count(*) AS n, count(DISTINCT date) AS days, max(market) AS top FROM folds JOIN prices ON date BETWEEN oos_start AND oos_end GROUP BY fold")
def fold_windows(spark, sf):
    """A range join of a few windows with the panel."""
    windows = F.broadcast(folds(spark, sf).select("fold", "oos_start", "oos_end"))
    return panels.brand_prices(spark, sf).join(windows, F.col("date").between(F.col("oos_start"), F.col("oos_end"))).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.max("market").alias("top"))


_SEGMENTS = "seg AS (SELECT lpad(CAST(date_diff('day', DATE '2024-01-01', date) // 10 AS VARCHAR), 5, '0') AS run_id, date, equity FROM c)"


@query(f"WITH RECURSIVE c AS ({CURVE}), {_SEGMENTS}, b AS (SELECT run_id, arg_min(equity, date) AS base, arg_max(equity, date) AS fin, row_number() OVER (ORDER BY run_id) AS k FROM seg GROUP BY run_id), l AS (SELECT k, run_id, base, fin, base AS level FROM b WHERE k = 1 UNION ALL SELECT b.k, b.run_id, b.base, b.fin, l.level * l.fin / l.base FROM l JOIN b ON b.k = l.k + 1) SELECT run_id, date, round(level * equity / base, 4) AS equity FROM seg JOIN l USING (run_id)")
def stitched_curve(spark, sf):
    segment = F.lpad(F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 10).cast("string"), 5, "0")
    return rounded(research.stitch(panels.event_curve(spark, sf).select(segment.alias("run_id"), "date", "equity")), "equity", places=4)


_TYPES = "t AS (SELECT event_type, CAST(ts AS DATE) AS date, CAST(sum(CAST(round(value * 1e2) AS BIGINT)) AS DOUBLE) AS equity FROM events WHERE user_id % 3 <> 0 OR event_type <> 'error' GROUP BY ALL)"


@query(f"WITH {_TYPES} SELECT event_type, date, equity, equity / lag(equity) OVER (PARTITION BY event_type ORDER BY date) - 1 AS daily FROM t WHERE date IN (SELECT date FROM t GROUP BY date HAVING count(*) = (SELECT count(DISTINCT event_type) FROM t))")
def curve_alignment(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 3 <> 0 OR event_type <> 'error'")
    curves = events.groupBy("event_type", F.to_date("ts").alias("date")).agg(F.sum(F.round(F.col("value") * 1e2).cast("long")).cast("double").alias("equity"))
    n = F.broadcast(curves.agg(F.countDistinct("event_type").alias("k")))
    days = curves.groupBy("date").agg(F.count("*").alias("have")).join(n, F.col("have") == F.col("k")).select("date")
    last = F.lag("equity").over(Window.partitionBy("event_type").orderBy("date"))
    return curves.join(days, "date", "left_semi").withColumn("daily", F.col("equity") / last - 1)


# --- holdings: ledger positions valued at marks ------------------------------------------------------

_TRADES = "trades AS (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey % 25 + 1 AS product_id, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(1 + o_orderkey % 5 AS BIGINT) AS quantity, CAST(round(o_totalprice * 1e2) AS BIGINT) AS cents FROM orders)"


@query(f"WITH {_TRADES} SELECT product_id, date, CAST(sum(sum(quantity)) OVER w AS BIGINT) AS held, CAST(sum(sum(CASE WHEN quantity > 0 THEN -cents ELSE cents END)) OVER w AS BIGINT) AS cash_cents FROM trades GROUP BY product_id, date WINDOW w AS (PARTITION BY product_id ORDER BY date ROWS UNBOUNDED PRECEDING)")
def ledger_balances(spark, sf):
    """Running holdings and cash of a trade log, as sums of daily sums."""
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    trades = spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 25 + 1).alias("product_id"), (sign * (1 + F.col("o_orderkey") % 5)).alias("quantity"), F.round(F.col("o_totalprice") * 1e2).cast("long").alias("cents"))
    daily = trades.groupBy("product_id", "date").agg(F.sum("quantity").alias("q"), F.sum(F.when(F.col("quantity") > 0, -F.col("cents")).otherwise(F.col("cents"))).alias("c"))
    w = Window.partitionBy("product_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("product_id", "date", F.sum("q").over(w).alias("held"), F.sum("c").over(w).alias("cash_cents"))


@query(f"{WITH}, {_TRADES}, pos AS (SELECT product_id, CAST(sum(quantity) AS BIGINT) AS held FROM trades GROUP BY 1 HAVING sum(quantity) > 0), last AS (SELECT product_id, arg_max(market, date) AS mark FROM prices WHERE sub_type = 'N' GROUP BY 1) SELECT product_id, held, mark, held * mark AS value, coalesce(name, concat('product ', product_id)) AS name FROM pos JOIN last USING (product_id) LEFT JOIN products USING (product_id)")
def snapshot_pnl(spark, sf):
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    held = spark.read.parquet(f"{sf}/orders.parquet").groupBy((F.col("o_custkey") % 25 + 1).alias("product_id")).agg(F.sum(sign * (1 + F.col("o_orderkey") % 5)).alias("held")).where("held > 0")
    last = panels.brand_prices(spark, sf).where("sub_type = 'N'").groupBy("product_id").agg(F.max_by("market", "date").alias("mark"))
    named = held.join(last, "product_id").join(F.broadcast(panels.brand_products(spark, sf).select("product_id", "name")), "product_id", "left")
    return named.select("product_id", "held", "mark", (F.col("held") * F.col("mark")).alias("value"), F.coalesce("name", F.concat(F.lit("product "), "product_id")).alias("name"))


# --- backtests, walk-forward, statistics ---------------------------------------------------------------


def whole_run(spark, sf, name: str) -> DataFrame:
    """The results of a backtest from the panel's first day to its last."""
    prices = panels.brand_prices(spark, sf)
    return backtest(prices, panels.brand_products(spark, sf), research.one_run(spark, name, *panels.days(prices)))


def _backtest(name: str):
    def run(spark, sf):
        return curves_of(whole_run(spark, sf, name))

    run.__name__ = "backtest_" + name.replace("-", "_")
    return query()(run)


for _name in ("buy-and-hold", "sealed-accumulation", "dip-buyer", "xs-momentum", "cost-aware-reversion"):
    _backtest(_name)


@query()
def backtest_fills(spark, sf):
    return fills_of(whole_run(spark, sf, "dip-buyer"))


@query(f"""{WITH}, d AS (SELECT max(date) AS day FROM prices),
m AS (SELECT product_id, sub_type, arg_max(market, date) AS mark, arg_max(market, date) FILTER (WHERE date <= day - 60) AS past FROM prices, d WHERE date BETWEEN day - 365 AND day GROUP BY product_id, sub_type),
t AS (SELECT * FROM m JOIN products USING (product_id) WHERE kind = 'single' AND mark >= 3 AND past > 0 ORDER BY 1 - mark / past, product_id, sub_type LIMIT 10),
s AS (SELECT product_id, sub_type, name, CAST(floor(1e4 / (SELECT count(*) FROM t) / mark) AS BIGINT) AS quantity, mark AS market FROM t) SELECT * FROM s WHERE quantity > 0""")
def live_signals(spark, sf):
    """What momentum would enter on the latest day with 10,000 in cash and no positions."""
    found = live.recommend(panels.brand_prices(spark, sf), panels.brand_products(spark, sf), "xs-momentum", {}, cash=10_000.0)
    return found.select("product_id", "sub_type", "name", "quantity", "market")


@query()
def walkforward_summary(spark, sf):
    prices = panels.brand_prices(spark, sf)
    found = research.walk_forward(prices, panels.brand_products(spark, sf), "sealed-accumulation", *panels.days(prices))
    return found["best"].join(found["oos"], F.format_string("%05d", "fold") == F.col("run_id")).drop("run_id")


def _type_curves(spark, sf) -> DataFrame:
    """The mean price of each type by day, as curves to compare."""
    return panel_means(panels.brand_prices(spark, sf).withColumn("strategy", F.col("sub_type")))


def panel_means(prices: DataFrame) -> DataFrame:
    return prices.groupBy("strategy", "date").agg(F.avg("market").alias("equity"))


TYPES = f"""{WITH}, curve AS (SELECT sub_type AS strategy, date, avg(market) AS equity FROM prices GROUP BY ALL),
shared AS (SELECT * FROM curve WHERE date IN (SELECT date FROM curve GROUP BY date HAVING count(*) = (SELECT count(DISTINCT strategy) FROM curve))),
daily AS (SELECT *, equity / lag(equity) OVER (PARTITION BY strategy ORDER BY date) - 1 AS r FROM shared),
away AS (SELECT *, r - avg(r) OVER (PARTITION BY strategy) AS x FROM daily)"""


@query(f"""{TYPES} SELECT strategy, round(arg_max(equity, date) / arg_min(equity, date) - 1, 6) AS total_return, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std,
round(avg(r) / stddev_samp(r) * sqrt(365), 6) AS sharpe, round(avg(x ** 3) / avg(x ** 2) ** 1.5, 5) AS skew, round(avg(x ** 4) / avg(x ** 2) ** 2, 4) AS kurtosis,
count(*) AS n_days, min(date) AS start, max(date) AS "end" FROM away GROUP BY strategy""")
def evaluate_moments(spark, sf):
    """What an evaluation says of each curve over the days that all share, before any draw."""
    curves = _type_curves(spark, sf)
    n = curves.select("strategy").distinct().count()
    found = rounded(rigor.return_moments(metrics.aligned(curves, "strategy", n)), "total_return", "mean", "std", "sharpe")
    return rounded(rounded(found, "skew", places=5), "kurtosis", places=4)


@query()
def evaluate_summary(spark, sf):
    """The types' curves against the mean of all: intervals, deflated ratios and the check of the best."""
    everything = panels.brand_prices(spark, sf).withColumn("strategy", F.lit("all"))
    return rigor.evaluate(_type_curves(spark, sf), panel_means(everything).select("date", "equity"), draws=2000)


@query(f"""{WITH}, d AS (SELECT date, product_id, sub_type, high - low AS a, market AS b FROM prices WHERE high IS NOT NULL AND low IS NOT NULL),
r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2.0 AS a,
             rank() OVER (PARTITION BY date ORDER BY b) + (count(*) OVER (PARTITION BY date, b) - 1) / 2.0 AS b FROM d)
SELECT date, round(corr(a, b), 6) + 0.0 AS spearman FROM r GROUP BY date HAVING count(*) >= 3 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b))""")
def rank_correlation(spark, sf):
    """How well the spread ranks the assets of a day by price."""
    scored = panels.brand_prices(spark, sf).withColumn("spread", F.col("high") - F.col("low"))
    return rounded(research.spearman(scored, "spread", "market"), "spearman").withColumn("spearman", F.col("spearman") + F.lit(0.0))  # no negative zero


def _returns(spark, sf) -> np.ndarray:
    """Daily returns of the event curve: a row a day, so the driver may hold them."""
    rows = metrics.drawdown_curve(_curve(spark, sf), "run_id").where("daily IS NOT NULL").orderBy("date").select("daily").collect()
    return np.array([r["daily"] for r in rows])


@query()
def rigor_statistics(spark, sf):
    r = _returns(spark, sf)
    rows = [(m, *research.bootstrap_ci(r, m, draws=2000)) for m in ("total_return", "sharpe")]
    dsr = research.deflated_sharpe(r, [research.sharpe(r), research.sharpe(r[::2]), research.sharpe(r[1::2])])
    rows += [("deflated_sharpe", dsr, None, None), ("reality_check", research.reality_check(np.stack([r - r.mean(), r * 0.5]), draws=2000), None, None)]
    return spark.createDataFrame(rows, "metric STRING, point DOUBLE, low DOUBLE, high DOUBLE")
