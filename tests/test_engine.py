"""Hand-worked cases of the fold, the gates, features, curves, costs, statistics, sources and sinks."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.functions.costs import CostModel
from marketloom.operators import classify, features, metrics, panel, quality
from marketloom.plans import research
from marketloom.plans.simulate import Book, Fill, backtest, curves_of, fills_of, run_fold
from marketloom.plans.strategies import BuyAndHold, Strategy, resolve
from marketloom.schemas import PRICES, PRODUCTS
from marketloom.sources import ledger
from marketloom.sources.warehouse import Warehouse

D = dt.date


def price(day, pid, market, low=1.0, mid=2.0, high=3.0, sub="Normal"):
    return (day, pid, sub, low, mid, high, market)


def test_backtest_without_and_with_impact(spark):
    days = [D(2024, 3, k) for k in (1, 2, 3)]
    products = spark.createDataFrame([(1, 1, "Box", None, "sealed", D(2024, 1, 1))], PRODUCTS)
    for impact, mids, equity, fill in ((False, (2.0,) * 3, [100.0, 99.0, 123.0], (8, 12.0, 1.0, 0.0)), (True, (13.0, 16.0, 18.0), [100.0, 86.75, 107.75], (7, 12.0, 1.0, 12.25))):
        prices = spark.createDataFrame([price(d, 1, m, mid=q) for d, m, q in zip(days, (10.0, 12.0, 15.0), mids)], PRICES)
        result = backtest(prices, products, research.one_run(spark, "buy-and-hold", "2024-03-01", "2024-03-03", cash=100.0, impact=impact))
        assert [r["equity"] for r in curves_of(result).orderBy("date").collect()] == equity
        (f,) = fills_of(result).collect()
        assert (f["quantity"], f["price"], f["fees"], f["impact"]) == fill and f["day"] == days[1]


def test_orders_fill_on_the_next_data_day_or_expire():
    class Once(Strategy):
        n = 0

        def orders(self, view):
            self.n += 1
            return [((1, "N"), 1), ((2, "N"), 1)] if self.n == 1 else []

    free = CostModel(fee_rate=0.0, shipping=0.0)
    days = {D(2024, 1, 1): {(1, "N"): (10.0, None, None), (2, "N"): (5.0, None, None)}, D(2024, 1, 5): {(1, "N"): (10.0, None, None)}, D(2024, 1, 6): {(1, "N"): (20.0, None, None), (2, "N"): (5.0, None, None)}}
    fills, curve = run_fold(days, {}, Once(), D(2024, 1, 1), 100.0, free)
    assert [e for _, e in curve] == [100.0, 100.0, 110.0]
    assert [(f.day, f.asset) for f in fills] == [(D(2024, 1, 5), (1, "N"))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0.5, 500), st.floats(0.5, 500), st.floats(0, 5)), min_size=1, max_size=8))
def test_round_trips_leave_cash_equal_to_profit(trips):
    book = Book(1e6)
    for n, buy, sell, fee in trips:
        book.apply(Fill(D(2024, 1, 1), (1, "N"), n, buy, fee, 0.0))
        book.apply(Fill(D(2024, 1, 2), (1, "N"), -n, sell, fee, 0.0))
    assert not book.positions and math.isclose(book.cash, 1e6 + book.realized, rel_tol=1e-12)


def test_gates(spark):
    rows = [price(D(2024, 1, 1), 1, 10.0), price(D(2024, 1, 2), 1, 150.0), price(D(2024, 1, 3), 1, 150.0), price(D(2024, 1, 4), 1, 10.0), price(D(2024, 1, 1), 2, None), price(D(2024, 1, 1), 3, 0.0), price(D(2024, 1, 1), 4, 5.0), price(D(2024, 1, 1), 4, 6.0)]
    got = quality.with_reason(spark.createDataFrame(rows, PRICES)).orderBy("product_id", "date").collect()
    assert [r["reason"] for r in got] == [None, "price_jump", None, "price_jump", "null_market", "nonpositive_market", "duplicate", "duplicate"]


def test_gate_equals_the_day_by_day_definition(spark):
    rnd, rows = random.Random(3), []
    for day in range(40):
        for pid in range(12):
            for _ in range(rnd.choice([0, 1, 1, 1, 1, 1, 2])):
                rows.append(price(D(2024, 1, 1) + dt.timedelta(day), pid, rnd.choice([None, 0.0, 1.0, 2.0, 15.0, 30.0, 300.0])))
    want, before = {}, {}
    for day in sorted({r[0] for r in rows}):
        clean = {}
        for pid in range(12):
            todays = [r for r in rows if r[0] == day and r[1] == pid]
            for r in todays:
                m = r[6]
                reason = "null_market" if m is None else "nonpositive_market" if m <= 0 else "duplicate" if len(todays) > 1 else "price_jump" if pid in before and not 0.1 <= m / before[pid] <= 10 else None
                want.setdefault((day, pid), []).append(reason)
                if reason is None:
                    clean[pid] = m
        before = clean
    got = {}
    for r in quality.with_reason(spark.createDataFrame(rows, PRICES)).collect():
        got.setdefault((r["date"], r["product_id"]), []).append(r["reason"])
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def _ramp(spark):
    day = lambda k: D(2024, 1, 1) + dt.timedelta(k)
    return spark.createDataFrame([price(day(k), 1, 100.0 + max(0, k - 9)) for k in range(40)], PRICES), day


def test_features_by_hand_and_without_the_future(spark):
    prices, day = _ramp(spark)
    products = spark.createDataFrame([(1, 1, "Box", None, "sealed", D(2023, 12, 31))], PRODUCTS)
    row = features.features_v1(prices, products).where(F.col("date") == day(39)).first()
    assert math.isclose(row["ret_7d"], 130 / 123 - 1) and math.isclose(row["ret_30d"], 0.3) and row["dip_90d"] == 0 and row["ret_90d"] is None and row["is_sealed"] == 1 and row["days_since_release"] == 40
    early = prices.where(F.col("date") <= day(30))
    same = lambda p: sorted(map(str, features.features_v2(p, products).where(F.col("date") <= day(30)).collect()))
    assert same(prices) == same(early)


def test_returns_whose_base_lies_outside_the_frame_do_not_count(spark):
    rows = [price(d, 1, m) for d, m in ((D(2024, 1, 1), 100.0), (D(2024, 2, 10), 50.0), (D(2024, 2, 12), 60.0), (D(2024, 2, 14), 66.0))]
    got = spark.createDataFrame(rows, PRICES).withColumn("v", features.spread_of_returns(30)).orderBy("date").collect()
    assert got[2]["v"] is None and math.isclose(got[3]["v"], np.std([0.2, 0.1], ddof=1))


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "N", D(2024, 1, 5)), (1, "N", D(2023, 1, 5)), (2, "N", D(2024, 1, 5))], "product_id BIGINT, sub_type STRING, date DATE")
    right = spark.createDataFrame([(1, "N", D(2024, 1, 5), 3.0), (1, "N", D(2024, 1, 2), 2.0)], "product_id BIGINT, sub_type STRING, date DATE, market DOUBLE")
    got = {(r["product_id"], r["date"]): r["market_as_of"] for r in panel.as_of(left, right, "market").collect()}
    assert got == {(1, D(2024, 1, 5)): 3.0, (1, D(2023, 1, 5)): None, (2, D(2024, 1, 5)): None}


def test_round_trip_cost_and_tiers(spark):
    df = spark.createDataFrame([(10.0, 10.5, 9.0)], "market DOUBLE, mid DOUBLE, low DOUBLE")
    assert math.isclose(df.select(CostModel(impact=True).round_trip_fraction(F.col("market"), F.col("mid"), F.col("low"))).first()[0], 0.336875)
    assert [CostModel().daily_cap(x) for x in (4.99, 5.0, 50.0, 200.0)] == [20, 8, 3, 1]


def test_folds_and_stitching(spark):
    folds = research.make_folds(spark, "2024-01-01", "2024-02-09", 10, 10)
    assert folds.count() == 3
    rows = [(f"{k}", D(2024, 1, 11) + dt.timedelta(10 * k + i), e) for k, (a, b) in enumerate(((1000.0, 1024.0), (500.0, 512.0), (10.0, 10.24))) for i, e in ((0, a), (9, b))]
    got = [r["equity"] for r in research.stitch(spark.createDataFrame(rows, "run_id STRING, date DATE, equity DOUBLE")).orderBy("date").collect()]
    assert np.allclose(got, [1000, 1024, 1024, 1048.576, 1048.576, 1073.741824])


def test_metrics_of_degenerate_curves(spark):
    one = spark.createDataFrame([("a", D(2024, 1, 1), 5.0), ("b", D(2024, 1, 1), 0.0), ("b", D(2024, 1, 2), 3.0)], "run_id STRING, date DATE, equity DOUBLE")
    assert all(r[k] == 0.0 for r in metrics.summarize(one, "run_id").collect() for k in ("total_return", "cagr", "max_drawdown", "sharpe", "sortino", "calmar"))


def test_statistics():
    r = np.random.default_rng(1).normal(0.001, 0.01, 400)
    assert research.bootstrap_ci(r, draws=500) == research.bootstrap_ci(r, draws=500)
    point, low, high = research.bootstrap_ci(r, "sharpe", draws=500)
    assert low < point < high
    noise = np.random.default_rng(2).normal(0, 0.01, (4, 600))
    edge = np.vstack([noise, np.random.default_rng(3).normal(0.004, 0.01, 600)])
    assert research.reality_check(noise, draws=1000) > 0.05 > research.reality_check(edge, draws=1000)
    assert research.deflated_sharpe(np.ones(10) * 0.0, [0.1, 0.2]) is None
    train, held = research.purged_split([D(2024, 1, 1) + dt.timedelta(30 * k) for k in range(10)], 30)
    assert len(held) == 2 and max(train) <= held[0] - dt.timedelta(30)


def test_parameters():
    assert resolve("dip-buyer", {"hold": "90.9"})["hold"] == 90
    with pytest.raises(ValueError, match="no parameter"):
        resolve("dip-buyer", {"x": 1})
    assert research.sample_params("dip-buyer", 7, 5) == research.sample_params("dip-buyer", 7, 5)
    assert isinstance(BuyAndHold(kind="sealed"), Strategy)


def test_raw_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"productId": 5, "groupId": 2, "name": "A", "presaleInfo": {"releasedOn": "2024-02-03T00:00:00"}, "extendedData": [{"name": "Rarity", "value": " code Card "}]}, {"productId": 6, "groupId": 2, "name": "B", "presaleInfo": {"releasedOn": None}, "extendedData": []}]}))
    rows = classify.products_frame(spark.read.option("multiLine", True).json(str(tmp_path / "p.json"))).orderBy("product_id").collect()
    assert [(r["kind"], r["released_on"]) for r in rows] == [("excluded", D(2024, 2, 3)), ("sealed", None)]


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    assert w.load_prices().isEmpty() and w.stored_days() == []
    with pytest.raises(FileNotFoundError):
        w.query("SELECT 1")
    w.write_prices(spark.createDataFrame([price(D(2024, 1, 1), 1, 5.0), price(D(2024, 1, 2), 1, 6.0)], PRICES))
    w.write_prices(spark.createDataFrame([price(D(2024, 1, 2), 1, 7.0)], PRICES))
    (tmp_path / "w" / "prices" / "date=oops").mkdir()
    assert w.stored_days() == ["2024-01-01", "2024-01-02"] and w.has_day("2024-01-02")
    assert [r["market"] for r in w.query("SELECT market FROM prices ORDER BY date").collect()] == [5.0, 7.0]
    assert w.load_day("2024-01-02").count() == 1


def test_streamed_ingest_gates_each_day_against_the_last_clean_one(spark, tmp_path):
    from marketloom.streaming import ingest

    w, source = Warehouse(spark, str(tmp_path / "w")), str(tmp_path / "in")
    for day, market in ((1, 10.0), (2, 150.0), (3, 150.0), (4, 10.0)):
        spark.createDataFrame([price(D(2024, 1, day), 1, market), price(D(2024, 1, day), 2, 1.0)], PRICES).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark, source, w, str(tmp_path / "c")).awaitTermination()
    clean = w.load_prices().where("product_id = 1").orderBy("date").collect()
    assert [r["date"].day for r in clean] == [1, 3]


def test_ledger(tmp_path):
    path = str(tmp_path / "l.jsonl")
    ledger.append(path, [{"date": "2024-01-01", "kind": "deposit", "amount": 1000}, {"date": "2024-01-02", "kind": "buy", "product_id": 1, "sub_type": "N", "qty": 2, "price": 100, "fees": 5}, {"date": "2024-01-03", "kind": "sell", "product_id": 1, "sub_type": "N", "qty": 1, "price": 150, "fees": 20}])
    book = ledger.replay(ledger.load(path))
    assert book.cash == 925 and book.realized == 25 and book.positions[1, "N"].quantity == 1 and book.positions[1, "N"].avg_cost == 100
    with pytest.raises(ValueError, match="line 4"):
        ledger.append(path, [{"date": "2024-01-04", "kind": "withdraw", "amount": 2000}])
    assert len(ledger.load(path)) == 3


def test_queries_have_sql_under_their_names():
    from marketloom import catalog

    assert set(catalog.oracle_sql()) < set(catalog.queries())


def test_registered_backtests_run_over_the_whole_panel(spark):
    from marketloom import catalog
    from marketloom.plans.research import make_folds, sample_params
    from marketloom.sources import panels

    sf, found = "/root/testdata/sf0.001", catalog.queries()
    prices = panels.brand_prices(spark, sf)
    days = {r["date"] for r in prices.select("date").distinct().collect()}
    for name in ("backtest_buy_and_hold", "backtest_cost_aware_reversion"):
        assert {r["date"] for r in found[name](spark, sf).select("date").collect()} == days
    assert {r["day"].year for r in found["backtest_fills"](spark, sf).select("day").collect()} - {1996}
    folds = {r["fold"]: r["oos_end"] for r in make_folds(spark, str(min(days)), str(max(days)), 180, 60).collect()}
    rows = found["walkforward_summary"](spark, sf).collect()
    assert {r["fold"]: r["oos_end"] for r in rows} == folds and (max(days) - max(folds.values())).days < 60
    tried = [json.dumps(p, sort_keys=True) for p in sample_params("sealed-accumulation", 42, 25)]
    assert {r["params"] for r in rows} <= set(tried)


def test_parameters_are_held_against_their_range():
    from marketloom.plans.strategies import resolve

    assert resolve("dip-buyer", {"window": "7.9"})["window"] == 7
    for bad in ({"threshold": 5}, {"threshold": "nan"}, {"window": "inf"}, {"max_positions": -3}, {"hold": None}):
        with pytest.raises(ValueError):
            resolve("dip-buyer", bad)


def test_evaluation(spark):
    from marketloom.plans import rigor

    rng, days = np.random.default_rng(3), [D(2024, 1, 1) + dt.timedelta(k) for k in range(200)]
    edge, flat, base = (np.cumprod(1 + r) for r in (rng.normal(0.01, 0.01, 200), rng.normal(0, 0.01, 200), rng.normal(0, 0.01, 200)))
    rows = [(n, d, float(v)) for n, x in (("edge", edge), ("flat", flat)) for d, v in zip(days, x)]
    curves = spark.createDataFrame(rows, "strategy STRING, date DATE, equity DOUBLE")
    bench = spark.createDataFrame([(d, float(v)) for d, v in zip(days[50:], base[50:])], "date DATE, equity DOUBLE")
    got = {r["strategy"]: r for r in rigor.evaluate(curves, bench, draws=400).collect()}
    assert got["edge"]["n_days"] == 150 and got["edge"]["start"] == days[50]
    assert np.isclose(got["edge"]["total_return"], edge[-1] / edge[50] - 1) and got["edge"]["low"] < got["edge"]["total_return"] < got["edge"]["high"]
    assert got["edge"]["reality_p"] < 0.05 and got["edge"]["deflated"] > got["flat"]["deflated"]
    r = np.diff(flat[50:]) / flat[50:-1]
    ratios = [rigor.sharpe(np.diff(x[50:]) / x[50:-1]) for x in (edge, flat)]
    assert np.isclose(got["flat"]["deflated"], rigor.deflated_sharpe(r, ratios))
    assert np.isclose(rigor.bootstrap_ci(r, draws=400)[1], got["flat"]["low"])
    with pytest.raises(ValueError, match="two strategies"):
        rigor.evaluate(curves.where("strategy = 'edge'"), bench)
    with pytest.raises(ValueError, match="days"):
        rigor.evaluate(curves, bench.limit(59))


def test_holdings_seed_a_run(spark, tmp_path):
    from marketloom.plans import simulate

    prices = spark.createDataFrame([(D(2024, 3, k), 1, "Normal", 1.0, 2.0, 3.0, 10.0 + k) for k in (1, 2, 3)] + [(D(2024, 3, 3), 2, "Normal", 1.0, 2.0, 3.0, 5.0)], "date DATE, product_id BIGINT, sub_type STRING, low DOUBLE, mid DOUBLE, high DOUBLE, market DOUBLE")
    products = spark.createDataFrame([(1, "single", None)], "product_id BIGINT, kind STRING, released_on DATE")
    (tmp_path / "h.csv").write_text("product_id,sub_type,quantity,avg_cost,opened_on\n1,Normal,4,9.5,2024-02-01\n")
    held = simulate.checked_holdings(prices, simulate.read_holdings(spark, str(tmp_path / "h.csv")), "2024-03-01", "2024-03-03")
    result = simulate.backtest(prices, products, research.one_run(spark, "buy-and-hold", "2024-03-01", "2024-03-03", cash=0.0), held)
    assert [r["equity"] for r in simulate.curves_of(result).orderBy("date").collect()] == [44.0, 48.0, 52.0]
    for product, why in ((2, "no price on or before"), (3, "doesn't print")):
        other = spark.createDataFrame([(product, "Normal", 1, 1.0, D(2024, 1, 1))], simulate.HOLDINGS)
        with pytest.raises(ValueError, match=why):
            simulate.checked_holdings(prices, other, "2024-03-01", "2024-03-03")
    (tmp_path / "bad.csv").write_text("product_id,quantity\n1,4\n")
    with pytest.raises(ValueError, match="columns"):
        simulate.read_holdings(spark, str(tmp_path / "bad.csv"))
