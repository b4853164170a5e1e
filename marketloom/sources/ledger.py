"""Trade ledgers: JSON lines of deposits, withdrawals, buys and sells, replayed in date order."""

from __future__ import annotations

import datetime as dt
import json
import math
from pathlib import Path

from ..plans.simulate import Book, Fill

KEYS = {"deposit": {"amount"}, "withdraw": {"amount"}, "buy": {"product_id", "sub_type", "qty", "price"}, "sell": {"product_id", "sub_type", "qty", "price"}}


def parse(line: str, number: int) -> dict:
    """One event; errors name the line."""
    try:
        e = json.loads(line)
        kind = e["kind"]
        extra = {"fees", "impact"} if kind in ("buy", "sell") else set()
        if not KEYS[kind] <= set(e) - {"date", "kind"} <= KEYS[kind] | extra:
            raise ValueError(f"keys {sorted(set(e) - {'date', 'kind'} ^ KEYS[kind])}")
        e["date"] = dt.date.fromisoformat(e["date"])
        for k in ("amount", "price", "qty", "fees", "impact"):
            if k in e and (isinstance(e[k], bool) or not math.isfinite(e[k]) or e[k] < 0 or (k not in ("fees", "impact") and e[k] == 0)):
                raise ValueError(f"{k} is {e[k]}")
        return e | {"line": number}
    except (KeyError, TypeError, ValueError) as error:
        raise ValueError(f"line {number}: {error}") from error


def load(path: str) -> list[dict]:
    p = Path(path)
    return [parse(x, n) for n, x in enumerate(p.read_text().splitlines(), 1) if x.strip()] if p.exists() else []


def replay(events: list[dict]) -> Book:
    """The book after all events, by date, then line. Cash within half a cent below zero is zero; below that is an error."""
    book = Book(0.0)
    for e in sorted(events, key=lambda e: e["date"]):
        if e["kind"] in ("deposit", "withdraw"):
            book.cash += e["amount"] if e["kind"] == "deposit" else -e["amount"]
        else:
            sign = 1 if e["kind"] == "buy" else -1
            try:
                book.apply(Fill(e["date"], (e["product_id"], e["sub_type"]), sign * e["qty"], e["price"], e.get("fees", 0.0), e.get("impact", 0.0)))
            except ValueError as error:
                raise ValueError(f"line {e['line']}: {error}") from error
        if book.cash < 0:
            if book.cash <= -0.005:
                raise ValueError(f"line {e['line']}: cash falls to {book.cash:.2f}")
            book.cash = 0.0
    return book


def append(path: str, events: list[dict]) -> None:
    """All events or none: the whole ledger is replayed with them first."""
    old = load(path)
    lines = [json.dumps(e, default=str, sort_keys=True) for e in events]
    replay(old + [parse(x, len(old) + n) for n, x in enumerate(lines, 1)])
    with open(path, "a") as f:
        f.writelines(x + "\n" for x in lines)
