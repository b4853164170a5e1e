"""The command line: ``python -m marketloom --root FOLDER COMMAND``; results are printed as JSON."""

from __future__ import annotations

import argparse
import datetime as dt
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators.metrics import summarize
from .plans import live, research, rigor
from .plans.simulate import backtest, checked_holdings, curves_of, fills_of, read_holdings
from .plans.strategies import PARAMS
from .sources import ledger, runs
from .sources.warehouse import Warehouse


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marketloom")
    p.add_argument("--root", default="data", help="folder of the warehouse, the ledger and the runs")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple[str, dict]) -> None:
        c = commands.add_parser(name)
        for flag, how in flags:
            c.add_argument(flag, **how)

    strategy = ("--strategy", {"default": "sealed-accumulation", "choices": sorted(PARAMS)})
    span = (("--start", {"required": True}), ("--end", {"required": True}))
    money = (("--cash", {"type": float, "default": 10_000.0}), ("--impact", {"action": argparse.BooleanOptionalAction, "default": True}))
    params = ("--param", {"action": "append", "default": [], "metavar": "NAME=VALUE"})
    whole = lambda flag, default: (flag, {"type": int, "default": default})
    command("backtest", *span, ("--strategy", {"default": "buy-and-hold", "choices": sorted(PARAMS)}), params, *money, whole("--warmup-days", 0), ("--holdings", {"help": "a CSV file of what the run begins with"}))
    command("walkforward", *span, strategy, *money, whole("--is-days", 180), whole("--oos-days", 60), whole("--trials", 25), whole("--seed", 42), whole("--warmup-days", 120), ("--objective", {"default": "total_return", "choices": research.OBJECTIVES}))
    command("signals", strategy, ("--cash", {"type": float}), ("--portfolio", {"action": "store_true"}), whole("--warmup-days", 365))
    command("daily", strategy, ("--paper", {"action": "store_true"}), money[1], ("--day", {"type": dt.date.fromisoformat, "default": None}))
    command("portfolio", ("action", {"choices": ["deposit", "withdraw", "buy", "sell", "show"]}), ("--date", {}), ("--amount", {"type": float}), ("--product-id", {"type": int}), ("--sub-type", {}), ("--qty", {"type": int}), ("--price", {"type": float}), ("--fees", {"type": float}), ("--impact", {"type": float}))
    command("runs", ("action", {"choices": ["list", "show"]}), ("--run-id", {"default": "", "help": "or its beginning"}), ("--of", {"help": "runs of a command"}), ("--strategy", {}))
    command("evaluate", whole("--draws", 10_000), ("--block", {"type": float, "default": 10.0}), whole("--seed", 42), ("--level", {"type": float, "default": 0.95}))
    command("version")
    command("sql", ("text", {}))
    return p


def newest_params(root: str, strategy: str) -> dict:
    """The parameters of the last fold of the strategy's latest walk-forward."""
    found = runs.latest_walk_forward(f"{root}/results", strategy)
    if not found or not found["folds"]:
        raise SystemExit(f"no walk-forward of {strategy} under {root}/results; run walkforward first")
    return found["folds"][-1]["params"]


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(given)
    book_path, registry = f"{a.root}/ledger.jsonl", f"{a.root}/runs/registry.jsonl"
    show = lambda x: print(json.dumps(x, default=str))
    if a.command == "runs":
        for r in runs.chosen(runs.load(registry), a.of, a.strategy, a.run_id):
            show(r if a.action == "show" else {k: r[k] for k in ("run_id", "command", "strategy", "results")})
        return 0
    if a.command == "version":
        show({"version": __version__})
        return 0
    if a.command == "portfolio":
        if a.action == "show":
            book = ledger.replay(ledger.load(book_path))
            show({"cash": book.cash, "realized": book.realized, "positions": [{"product_id": k[0], "sub_type": k[1], **vars(p)} for k, p in book.positions.items()]})
        else:
            Path(a.root).mkdir(parents=True, exist_ok=True)
            event = {"date": a.date or dt.date.today().isoformat(), "kind": a.action, "amount": a.amount, "product_id": a.product_id, "sub_type": a.sub_type, "qty": a.qty, "price": a.price, "fees": a.fees, "impact": a.impact}
            ledger.append(book_path, [{k: v for k, v in event.items() if v is not None}])
        return 0
    spark = spark or SparkSession.builder.appName("marketloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    w = Warehouse(spark, f"{a.root}/warehouse")
    if a.command == "sql":
        for line in w.query(a.text).toJSON().toLocalIterator():
            print(line)
        return 0
    if a.command == "evaluate":
        found = rigor.evaluate(runs.stitched_curves(spark, f"{a.root}/results"), runs.benchmark_curve(spark, registry), a.draws, a.block, a.seed, a.level)
        rows = [r.asDict() for r in found.orderBy("strategy").collect()]
        how = {"draws": a.draws, "block": a.block, "seed": a.seed, "level": a.level}
        folder = runs.save_evaluation(f"{a.root}/results", dt.date.today(), rows, how)
        runs.record(registry, a.command, "all", how, {r["strategy"]: r["deflated"] for r in rows}, folder, w)
        for r in rows:
            show(r)
        return 0
    prices, products = w.load_prices(), w.load_products()
    if a.command == "backtest":
        plan = research.one_run(spark, a.strategy, a.start, a.end, a.cash, a.warmup_days, a.impact, **dict(x.split("=", 1) for x in a.param))
        held = checked_holdings(prices, read_holdings(spark, a.holdings), a.start, a.end, a.warmup_days) if a.holdings else []
        done = backtest(prices, products, plan, held)
        run_id = runs.new_id()
        folder = runs.save_backtest(f"{a.root}/results", run_id, curves_of(done), fills_of(done))
        rows = summarize(spark.read.parquet(f"file://{folder}/equity.parquet").withColumn("run_id", F.lit(run_id)), "run_id").drop("run_id").collect()
        if not rows:
            raise SystemExit("there are no prices in these days")
        result = rows[0].asDict()
        runs.record(registry, a.command, a.strategy, {k: v for k, v in vars(a).items() if k != "root"}, result, folder, w, run_id=run_id)
        show(result)
    elif a.command == "walkforward":
        found = research.walk_forward(prices, products, a.strategy, a.start, a.end, a.is_days, a.oos_days, a.trials, a.seed, a.warmup_days, a.cash, a.objective, a.impact)
        rows = summarize(found["curve"].selectExpr("'all' AS run_id", "date", "equity"), "run_id").drop("run_id").collect()
        if not rows:
            raise SystemExit("there is no fold with prices in these days")
        result, run_id = rows[0].asDict(), runs.new_id()
        folder = runs.save_walk_forward(f"{a.root}/results", run_id, a.strategy, found, result)
        runs.record(registry, a.command, a.strategy, {k: v for k, v in vars(a).items() if k != "root"}, result, folder, w, run_id=run_id)
        show(result)
    elif a.command == "signals":
        if a.cash is not None and a.portfolio:
            raise SystemExit("signals are for cash or for the portfolio")
        held = {"book": ledger.replay(ledger.load(book_path))} if a.portfolio else {"cash": 10_000.0 if a.cash is None else a.cash}
        for r in live.recommend(prices, products, a.strategy, newest_params(a.root, a.strategy), warmup=a.warmup_days, **held).orderBy("place").collect():
            show(r.asDict())
    else:
        print(live.report(live.daily(w, a.strategy, newest_params(a.root, a.strategy), book_path, a.day or dt.date.today(), a.paper, a.impact)), end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
