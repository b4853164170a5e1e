"""Daily-bar backtests: the one sequential fold, run as a grouped map with a task for each run.

Orders of a bar are tried on the next trading day at that day's print, or expire.
Everything set-based (window, universe, metrics) stays outside as DataFrame work;
a run's prints, bounded by its window, go through one task, and runs in parallel.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import CostModel
from ..schemas import ASSET
from .strategies import make_strategy

Asset = tuple[int, str]
OUTPUT = "run_id STRING, kind STRING, day DATE, product_id BIGINT, sub_type STRING, quantity BIGINT, price DOUBLE, fees DOUBLE, impact DOUBLE, equity DOUBLE"
RUNS = "run_id STRING, strategy STRING, params STRING, start DATE, end DATE, warmup INT, cash DOUBLE, impact BOOLEAN"


@dataclass
class Position:
    quantity: int
    avg_cost: float
    opened_on: dt.date


class Fill(NamedTuple):
    day: dt.date
    asset: Asset
    quantity: int
    price: float
    fees: float
    impact: float


@dataclass
class Book:
    cash: float
    realized: float = 0.0
    positions: dict[Asset, Position] = field(default_factory=dict)

    def apply(self, f: Fill) -> None:
        """Average-cost accounting; fees and impact are realised at once and aren't part of the average."""
        if f.quantity == 0 or not f.price > 0:
            raise ValueError(f"a fill needs a quantity and a price: {f}")
        value = abs(f.quantity) * f.price
        held = self.positions.get(f.asset)
        if f.quantity > 0:
            self.cash -= value + f.fees + f.impact
            self.realized -= f.fees + f.impact
            if held:
                held.avg_cost = (held.avg_cost * held.quantity + value) / (held.quantity + f.quantity)
                held.quantity += f.quantity
            else:
                self.positions[f.asset] = Position(f.quantity, value / f.quantity, f.day)
            return
        if not held or held.quantity < -f.quantity:
            raise ValueError(f"sells more than is held: {f}")
        self.cash += value - f.fees - f.impact
        self.realized += value + f.quantity * held.avg_cost - f.fees - f.impact
        held.quantity += f.quantity
        if not held.quantity:
            del self.positions[f.asset]

    def equity(self, marks: dict[Asset, float]) -> float:
        return self.cash + sum(p.quantity * marks[a] for a, p in self.positions.items())

    def seed(self, holdings: list[tuple[Asset, int, float, dt.date]]) -> None:
        """Holdings from before the run; neither cash nor profit changes. All are checked before any is taken."""
        for asset, quantity, cost, _ in holdings:
            if quantity <= 0 or not math.isfinite(cost) or cost < 0:
                raise ValueError(f"a holding needs a positive quantity and a cost: {asset}")
        for asset, quantity, cost, opened in holdings:
            if asset in self.positions:
                raise ValueError(f"a holding is given twice: {asset}")
            self.positions[asset] = Position(quantity, cost, opened)


def fill_orders(book: Book, orders: list[tuple[Asset, int]], prints: dict[Asset, tuple[float, float | None, float | None]], day: dt.date, costs: CostModel) -> list[Fill]:
    """Fills of a day, in order; the cap of an asset and day is shared by both sides."""
    used: dict[Asset, int] = {}
    out = []
    for asset, wanted in orders:
        market, mid, low = prints.get(asset, (0.0, None, None))
        if not wanted or not market or market <= 0:
            continue
        before = used.get(asset, 0)
        room = costs.daily_cap(market) - before
        if wanted > 0:
            spread = None if mid is None else mid - market
            n = min(wanted, room, math.floor((book.cash - costs.shipping) / market))
            while n > 0 and n * market + costs.shipping + costs.impact_cost(spread, market, n, before) > book.cash:
                n -= 1
            fees, sign = costs.shipping, 1
        else:
            spread = None if low is None else market - low
            held = book.positions.get(asset)
            n, sign = min(-wanted, held.quantity if held else 0, room), -1
            fees = n * market * costs.fee_rate + costs.shipping
        if n <= 0:
            continue
        f = Fill(day, asset, sign * n, market, fees, costs.impact_cost(spread, market, n, before))
        book.apply(f)
        used[asset] = before + n
        out.append(f)
    return out


class View:
    """What a strategy sees of a bar: nothing after its day."""

    def __init__(self, meta: dict[int, tuple[str, dt.date | None]], book: Book):
        self.meta, self.book, self.day = meta, book, dt.date.min
        self.marks: dict[Asset, float] = {}
        self.history: dict[Asset, tuple[list[dt.date], list[float], list[float]]] = {}  # days, prices, running peaks

    def observe(self, day: dt.date, prints: dict[Asset, tuple]) -> None:
        self.day = day
        for asset, (market, *_) in prints.items():
            self.marks[asset] = market
            days, prices, peaks = self.history.setdefault(asset, ([], [], []))
            days.append(day)
            prices.append(market)
            peaks.append(max(market, peaks[-1]) if peaks else market)

    def past(self, asset: Asset, days: int) -> float | None:
        when, prices, _ = self.history[asset]
        at = bisect_right(when, self.day - dt.timedelta(days))
        return prices[at - 1] if at else None

    def high(self, asset: Asset, days: int) -> float | None:
        """The highest print on or after so many days ago."""
        when, prices, _ = self.history[asset]
        at = bisect_right(when, self.day - dt.timedelta(days + 1))
        return max(prices[at:], default=None)

    def peak(self, asset: Asset) -> float:
        return self.history[asset][2][-1]

    def kind(self, asset: Asset) -> str:
        return self.meta.get(asset[0], ("other", None))[0]

    def released(self, asset: Asset) -> dt.date | None:
        return self.meta.get(asset[0], ("other", None))[1]


def run_fold(days: dict[dt.date, dict[Asset, tuple]], meta: dict, strategy, start: dt.date, cash: float, costs: CostModel, holdings: list = ()) -> tuple[list[Fill], list[tuple[dt.date, float]]]:
    """(fills, curve): days before ``start`` are only seen."""
    book, pending, fills, curve = Book(cash), [], [], []
    book.seed(list(holdings))
    view = View(meta, book)
    for day in sorted(days):
        prints = days[day]
        if day < start:
            view.observe(day, prints)
            continue
        fills += fill_orders(book, pending, prints, day, costs)
        view.observe(day, prints)
        pending = strategy.orders(view)
        curve.append((day, book.equity(view.marks)))
    return fills, curve


def bars(prices: DataFrame, products: DataFrame) -> DataFrame:
    """Prints with what the catalogue says of their product."""
    catalogue = products.select("product_id", F.col("kind").alias("product_kind"), "released_on")
    return prices.select("date", *ASSET, "market", "mid", "low").join(catalogue, "product_id", "left")


def read_window(rows: pd.DataFrame) -> tuple[dict[dt.date, dict[Asset, tuple]], dict[int, tuple]]:
    """(prints by day, kind and release of products) of a window's bars."""
    none = lambda x: None if pd.isna(x) else x
    days: dict = {}
    meta: dict = {}
    for r in rows.sort_values(["date", "product_id", "sub_type"]).itertuples():
        days.setdefault(r.date, {})[int(r.product_id), r.sub_type] = (float(r.market), none(r.mid), none(r.low))
        if none(r.product_kind):
            meta[int(r.product_id)] = (r.product_kind, none(r.released_on))
    return days, meta


#: Holdings that a run may begin with.
MOST_HOLDINGS = 100_000
HOLDINGS = "product_id BIGINT, sub_type STRING, quantity BIGINT, avg_cost DOUBLE, opened_on DATE"


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Holdings of a CSV file with a header; a file without its columns, or with others, is an error."""
    found = spark.read.option("header", True).csv(path)
    names = [c.split()[0] for c in HOLDINGS.split(", ")]
    if sorted(found.columns) != sorted(names):
        raise ValueError(f"holdings have the columns {', '.join(names)}")
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(", ".join(next(c for c in HOLDINGS.split(", ") if c.split()[0] == n) for n in found.columns)).csv(path).select(*names)


def checked_holdings(prices: DataFrame, holdings: DataFrame, start: str, end: str, warmup: int = 0) -> list[tuple]:
    """The holdings as rows of a run, if each asset prints in the run's days and has a mark on the first of them; else ValueError."""
    rows = holdings.orderBy(*ASSET).limit(MOST_HOLDINGS + 1).collect()
    if len(rows) > MOST_HOLDINGS:
        raise ValueError(f"a run begins with {MOST_HOLDINGS} holdings at most")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    window = prices.where(F.col("date").between(F.date_sub(first, warmup), last))
    day = window.where(F.col("date") >= first).agg(F.min("date")).first()[0]
    if rows and day is None:
        raise ValueError("there is no trading day to begin with holdings")
    within = window.groupBy(*ASSET).agg(F.max((F.col("date") >= first).cast("int")).alias("prints"), F.min("date").alias("since"))
    for r in holdings.join(within, [*ASSET], "left").where("prints IS NULL OR prints = 0").orderBy(*ASSET).limit(1).collect():
        raise ValueError(f"{(r['product_id'], r['sub_type'])} doesn't print from {start} to {end}")
    for r in holdings.join(within, [*ASSET]).where(F.col("since") > F.lit(day)).orderBy(*ASSET).limit(1).collect():
        raise ValueError(f"{(r['product_id'], r['sub_type'])} has no price on or before {day}")
    return [((r["product_id"], r["sub_type"]), r["quantity"], r["avg_cost"], r["opened_on"]) for r in rows]


def backtest(prices: DataFrame, products: DataFrame, runs: DataFrame, holdings: list[tuple] = ()) -> DataFrame:
    """Fills and equity of all runs (schema RUNS), tagged by ``kind``; a run without prints has no rows. Each run begins with ``holdings``, of ``checked_holdings``.

    ``runs`` is a plan made by its caller, not data, and is broadcast with its
    windows; each run's slice of the panel goes to one task.
    """
    window = F.col("date").between(F.date_sub(F.col("start"), F.col("warmup")), F.col("end"))

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        run = rows.iloc[0]
        days, meta = read_window(rows)
        strategy = make_strategy(run["strategy"], json.loads(run["params"]))
        fills, curve = run_fold(days, meta, strategy, run["start"], float(run["cash"]), CostModel(impact=bool(run["impact"])), list(holdings))
        out = [(key[0], "fill", f.day, f.asset[0], f.asset[1], f.quantity, f.price, f.fees, f.impact, None) for f in fills]
        out += [(key[0], "equity", day, None, None, None, None, None, None, e) for day, e in curve]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        return frame.astype({"product_id": "Int64", "quantity": "Int64"})

    return bars(prices, products).join(F.broadcast(runs), window).groupBy("run_id").applyInPandas(fold, OUTPUT)


def curves_of(result: DataFrame) -> DataFrame:
    return result.where("kind = 'equity'").select("run_id", F.col("day").alias("date"), "equity")


def fills_of(result: DataFrame) -> DataFrame:
    return result.where("kind = 'fill'").select("run_id", "day", *ASSET, "quantity", "price", "fees", "impact")
