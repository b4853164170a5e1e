"""Signals, paper fills, the run registry and the command line."""

import datetime as dt
import json

import pytest

from marketloom.__main__ import main
from marketloom.functions.costs import CostModel
from marketloom.plans import live
from marketloom.plans.simulate import Book
from marketloom.schemas import PRICES, PRODUCTS
from marketloom.sources import ledger, runs
from marketloom.sources.warehouse import Warehouse

D = dt.date
LAST = D(2024, 1, 1) + dt.timedelta(120)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """One sealed product at 200 for 30 days, then at 100; its quotes are crossed, so there is no impact."""
    root = tmp_path_factory.mktemp("live")
    w = Warehouse(spark, f"{root}/warehouse")
    w.write_prices(spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(k), 1, "Normal", 1.0, 2.0, 3.0, 200.0 if k < 30 else 100.0) for k in range(121)], PRICES).coalesce(1))
    w.write_products(spark.createDataFrame([(1, 1, "Box", None, "sealed", D(2024, 1, 1))], PRODUCTS))
    return root


def test_signals_for_cash_and_for_holdings(spark, root):
    w = Warehouse(spark, f"{root}/warehouse")
    prices, products = w.load_prices(), w.load_products()
    (r,) = live.recommend(prices, products, "sealed-accumulation", {}, cash=1000.0).collect()
    assert (r["action"], r["product_id"], r["name"], r["quantity"], r["market"], r["notional"], r["avg_cost"]) == ("BUY", 1, "Box", 1, 100.0, 100.0, None)
    book = Book(1000.0)
    book.seed([((1, "Normal"), 25, 50.0, D(2024, 2, 1))])
    (r,) = live.recommend(prices, products, "sealed-accumulation", {}, book=book).collect()
    assert (r["action"], r["quantity"], r["avg_cost"], r["gain"]) == ("SELL", 25, 50.0, 1.0)
    (f,) = live.paper_fills([r], book, LAST, CostModel(impact=True))
    assert (f["kind"], f["qty"], f["price"], f["fees"], f["impact"]) == ("sell", 3, 100.0, 39.25, 148.5)  # 3 a day; a third of the spread of 99 goes with each, half of it on average
    assert book.positions[1, "Normal"].quantity == 25
    (v,) = live.holdings_value(prices, book).collect()
    assert (v["value"], v["profit"]) == (2500.0, 1250.0)
    for bad in ({}, {"cash": 1.0, "book": book}):
        with pytest.raises(ValueError, match="either"):
            live.recommend(prices, products, "dip-buyer", {}, **bad)
    with pytest.raises(ValueError, match="can't judge"):
        live.recommend(prices, products, "buy-and-hold", {}, book=book)
    with pytest.raises(ValueError, match="no prices"):
        live.recommend(prices.limit(0), products, "dip-buyer", {}, cash=1.0)


def test_daily_appends_paper_fills(spark, root, tmp_path):
    path = str(tmp_path / "l.jsonl")
    ledger.append(path, [{"date": "2024-01-01", "kind": "deposit", "amount": 1000}])
    w = Warehouse(spark, f"{root}/warehouse")
    status = live.daily(w, "sealed-accumulation", {}, path, LAST, paper=True)
    assert [(f["kind"], f["qty"], f["fees"], f["impact"]) for f in status["fills"]] == [("buy", 1, 1.0, 0.0)]
    assert "| BUY | Box | Normal | 1 | 100.00 | 100.00 |" in live.report(status)
    assert ledger.replay(ledger.load(path)).cash == 899
    assert live.daily(w, "sealed-accumulation", {}, path, LAST, paper=True)["fills"] == []


def test_registry(spark, root, tmp_path):
    path, w = str(tmp_path / "r" / "registry.jsonl"), Warehouse(spark, f"{root}/warehouse")
    assert runs.load(path) == []
    assert runs.config_hash({"a": 1, "b": 2}) == runs.config_hash({"b": 2, "a": 1})
    run_id = runs.record(path, "backtest", "dip-buyer", {"a": 1}, {"total_return": 0.5}, "x", w)
    with open(path, "a") as f:
        f.write('{"run_id": \n' + json.dumps(runs.load(path)[0] | {"more": 1}) + "\n")
    with pytest.warns(UserWarning, match="line 2"):
        found = runs.load(path)
    assert [r["run_id"] for r in found] == [run_id, run_id] and "more" not in found[1] and found[0]["data_fingerprint"]["rows"] == 121
    with pytest.warns(UserWarning, match="recorded"):
        assert runs.record(path, "backtest", "dip-buyer", {}, {}, "x", Warehouse(spark, str(tmp_path / "none"))) is None


def test_command_line(spark, root, capsys):
    at = ["--root", str(root)]
    with pytest.raises(SystemExit, match="no walk-forward"):
        main([*at, "signals"], spark)
    main([*at, "walkforward", "--start", "2024-01-01", "--end", "2024-04-29", "--is-days", "60", "--oos-days", "30", "--trials", "2", "--cash", "1000"], spark)
    main([*at, "signals", "--cash", "1000"], spark)
    main([*at, "portfolio", "deposit", "--date", "2024-01-01", "--amount", "500"])
    main([*at, "portfolio", "show"])
    main([*at, "sql", "SELECT count(*) AS n FROM prices"], spark)
    capsys.readouterr()
    main([*at, "runs", "list"])
    (run,) = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert run["command"] == "walkforward" and "total_return" in run["results"]
    main([*at, "backtest", "--start", "2024-01-01", "--end", "2024-02-29", "--cash", "1000"], spark)
    assert json.loads(capsys.readouterr().out)["total_return"] < 0
