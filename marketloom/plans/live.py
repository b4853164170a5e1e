"""Live signals: one bar of a strategy on the latest day, and paper fills of what it recommends."""

from __future__ import annotations

import copy
import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.costs import CostModel
from ..sources import ledger
from ..sources.warehouse import Warehouse
from .simulate import Book, View, bars, fill_orders, read_window
from .strategies import make_strategy, resolve

SIGNALS = "place INT, action STRING, product_id BIGINT, sub_type STRING, quantity BIGINT, market DOUBLE, avg_cost DOUBLE, mid DOUBLE, low DOUBLE"
#: Strategies whose exits need nothing but the positions and their days of entry.
FOR_HOLDINGS = ("sealed-accumulation", "dip-buyer", "xs-momentum", "cost-aware-reversion")


def recommend(prices: DataFrame, products: DataFrame, strategy: str, params: dict, cash: float | None = None, book: Book | None = None, warmup: int = 365, as_of: dt.date | None = None) -> DataFrame:
    """What the strategy orders on the latest day (or ``as_of``), by place: sells come before buys.

    Either ``cash`` is given, for what it would enter today with no positions, or
    a ledger's ``book``. The window's prints go through one task, as those of a
    backtest's run do. ``mid`` and ``low`` are that day's, null without a print.
    """
    if (cash is None) == (book is None):
        raise ValueError("signals need either cash or a book of holdings")
    if book is not None and strategy not in FOR_HOLDINGS:
        raise ValueError(f"{strategy} can't judge holdings; these can: {', '.join(FOR_HOLDINGS)}")
    params = resolve(strategy, params)
    day = as_of or prices.agg(F.max("date")).first()[0]
    if day is None:
        raise ValueError("there are no prices")
    book = book or Book(cash)

    def bar(rows: pd.DataFrame) -> pd.DataFrame:
        days, meta = read_window(rows)
        view = View(meta, copy.deepcopy(book))
        for d in sorted(days.keys() | {day}):
            view.observe(d, days.get(d, {}))
        out = []
        for place, (asset, n) in enumerate(make_strategy(strategy, params).orders(view)):
            held = book.positions.get(asset) if n < 0 else None
            _, mid, low = days.get(day, {}).get(asset, (None, None, None))
            out.append((place, "BUY" if n > 0 else "SELL", *asset, abs(n), view.marks[asset], held and held.avg_cost, mid, low))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SIGNALS.split(", ")])

    window = bars(prices, products).where(F.col("date").between(day - dt.timedelta(warmup), day))
    found = window.withColumn("run", F.lit(0)).groupBy("run").applyInPandas(bar, SIGNALS)
    named = found.join(F.broadcast(products.select("product_id", "name")), "product_id", "left")
    return named.select(
        "place", "action", "product_id", "sub_type", F.coalesce("name", F.format_string("product %d", "product_id")).alias("name"), "quantity", "market",
        F.round(F.col("quantity") * F.col("market"), 2).alias("notional"), "avg_cost", F.when(F.col("avg_cost") > 0, F.col("market") / F.col("avg_cost") - 1).alias("gain"), "mid", "low",
    )


def paper_fills(recommended: list[Row], book: Book, day: dt.date, costs: CostModel) -> list[dict]:
    """Ledger events of the recommendations filled on the same day, clipped as a backtest's orders are; the book itself doesn't change."""
    orders = [((r["product_id"], r["sub_type"]), r["quantity"] if r["action"] == "BUY" else -r["quantity"]) for r in sorted(recommended, key=lambda r: r["place"])]
    prints = {(r["product_id"], r["sub_type"]): (r["market"], r["mid"], r["low"]) for r in recommended}
    return [
        {"date": day.isoformat(), "kind": "buy" if f.quantity > 0 else "sell", "product_id": f.asset[0], "sub_type": f.asset[1], "qty": abs(f.quantity), "price": f.price, "fees": round(f.fees, 2), "impact": round(f.impact, 2)}
        for f in fill_orders(copy.deepcopy(book), orders, prints, day, costs)
    ]


def holdings_value(prices: DataFrame, book: Book) -> DataFrame:
    """Each holding with its last mark, value and open profit; one without any print has nulls."""
    held = prices.sparkSession.createDataFrame([(*a, p.quantity, p.avg_cost, p.opened_on) for a, p in book.positions.items()], "product_id BIGINT, sub_type STRING, quantity BIGINT, avg_cost DOUBLE, opened_on DATE")
    last = prices.join(F.broadcast(held), ["product_id", "sub_type"], "left_semi").groupBy("product_id", "sub_type").agg(F.max_by("market", "date").alias("mark"))  # holdings of one ledger
    valued = held.join(last, ["product_id", "sub_type"], "left")
    return valued.withColumns({"value": F.col("quantity") * F.col("mark"), "profit": F.col("quantity") * (F.col("mark") - F.col("avg_cost"))})


def daily(warehouse: Warehouse, strategy: str, params: dict, ledger_path: str, day: dt.date, paper: bool = False, impact: bool = True, warmup: int = 365) -> dict:
    """The day's status: signals for the ledger's book and, for paper trading, the fills that were appended to it."""
    stored = warehouse.stored_days()
    if not stored:
        raise ValueError("there are no prices")
    book = ledger.replay(ledger.load(ledger_path))
    as_of = dt.date.fromisoformat(stored[-1])
    rows = recommend(warehouse.load_prices(), warehouse.load_products(), strategy, params, book=book, warmup=warmup, as_of=as_of).orderBy("place").collect()  # at most a strategy's orders of a day
    events = paper_fills(rows, book, day, CostModel(impact=impact)) if paper else []
    if events:
        ledger.append(ledger_path, events)
    return {"as_of": as_of.isoformat(), "day": day.isoformat(), "strategy": strategy, "params": resolve(strategy, params), "signals": [r.asDict() for r in rows], "fills": events}


def report(status: dict) -> str:
    """A day's status as Markdown."""
    lines = [f"# {status['strategy']} on {status['as_of']}", "", "| action | name | type | quantity | price | notional |", "|---|---|---|---:|---:|---:|"]
    lines += [f"| {r['action']} | {r['name']} | {r['sub_type']} | {r['quantity']} | {r['market']:.2f} | {r['notional']:.2f} |" for r in status["signals"]]
    return "\n".join([*lines, "", f"{len(status['fills'])} paper fills"]) + "\n"
