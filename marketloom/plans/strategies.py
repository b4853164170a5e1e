"""Strategies: what to order on a bar, sells before buys. ``view`` is a simulate.View."""

from __future__ import annotations

import math
from typing import NamedTuple

from ..functions.costs import CostModel


class Param(NamedTuple):
    name: str
    kind: type
    default: float | str
    low: float
    high: float
    log: bool = False


#: The parameters of each strategy, their defaults and search ranges.
_EXIT = (Param("take_profit", float, 1.25, 1.05, 2.0), Param("max_positions", int, 10, 3, 20), Param("budget_frac", float, 0.10, 0.02, 0.3))
_PRICE = Param("min_price", float, 3.0, 0.5, 20.0, True)
PARAMS: dict[str, tuple[Param, ...]] = {
    "buy-and-hold": (Param("kind", str, "sealed", 0, 0),),
    "sealed-accumulation": (Param("min_age", int, 60, 0, 180), Param("max_age", int, 365, 200, 900), Param("min_drawdown", float, 0.25, 0.05, 0.6), Param("take_profit", float, 1.5, 1.1, 3.0), *_EXIT[1:]),
    "dip-buyer": (Param("window", int, 7, 3, 30), Param("threshold", float, 0.30, 0.1, 0.6), Param("hold", int, 30, 7, 90), *_EXIT, _PRICE),
    "xs-momentum": (Param("lookback", int, 60, 14, 120), Param("top_n", int, 10, 3, 20), Param("rebalance", int, 30, 7, 60), _PRICE),
    "cost-aware-reversion": (Param("window", int, 30, 7, 90), Param("threshold", float, 0.25, 0.1, 0.6), Param("min_edge", float, 0.05, 0.0, 0.3), Param("take_profit", float, 1.25, 1.05, 2.0), Param("max_hold", int, 120, 30, 240), *_EXIT[1:], _PRICE),
}


def resolve(name: str, given: dict) -> dict:
    """Defaults filled in, values coerced (a float string for an int is cut) and held against their range; unknown names are errors."""
    if name not in PARAMS:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(PARAMS)}")
    known = {p.name: p for p in PARAMS[name]}
    if unknown := set(given) - set(known):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    out = {}
    for p in known.values():
        value = given.get(p.name, p.default)
        try:
            out[p.name] = str(value) if p.kind is str else int(float(value)) if p.kind is int else float(value)
        except (TypeError, ValueError, OverflowError) as e:
            raise ValueError(f"{name}: {p.name} can't be {value!r}") from e
        if p.kind is not str and not p.low <= out[p.name] <= p.high:
            raise ValueError(f"{name}: {p.name} is {out[p.name]}, outside {p.low} to {p.high}")
    return out


class Strategy:
    def __init__(self, **params):
        self.__dict__.update(params)

    def orders(self, view) -> list:
        raise NotImplementedError

    # what several share

    def exits(self, view, due) -> list:
        held = sorted(view.book.positions.items(), key=lambda x: x[0][0])
        return [(a, -p.quantity) for a, p in held if due(a, p)]

    def entries(self, view, sells: list, ranked: list) -> list:
        """Buys of the best candidates that aren't held, each for a share of the cash before the sells, into the free places."""
        free, budget = self.max_positions - (len(view.book.positions) - len(sells)), view.book.cash * self.budget_frac
        sized = [(a, math.floor(budget / view.marks[a])) for _, a in sorted(ranked)]
        return [x for x in sized if x[1] > 0][: max(0, free)]

    def fresh(self, view):
        return ((a, m) for a, m in view.marks.items() if a not in view.book.positions and m > 0)


class BuyAndHold(Strategy):
    done = False

    def orders(self, view):
        if self.done:
            return []
        self.done = True
        universe = sorted((a for a in view.marks if view.kind(a) == self.kind), key=lambda a: (a[0], view.history[a][0][0], a[1]))
        share = view.book.cash / len(universe) if universe else 0.0
        return [(a, n) for a in universe if (n := math.floor(share / view.marks[a])) > 0]


class SealedAccumulation(Strategy):
    def orders(self, view):
        sells = self.exits(view, lambda a, p: view.marks.get(a, 0.0) >= p.avg_cost * self.take_profit)
        ranked = []
        for a, mark in self.fresh(view):
            released = view.released(a)
            if view.kind(a) == "sealed" and released and self.min_age <= (view.day - released).days <= self.max_age:
                fall = 1 - mark / view.peak(a)
                if fall >= self.min_drawdown:
                    ranked.append((-fall, a))
        return sells + self.entries(view, sells, ranked)


class DipBuyer(Strategy):
    def orders(self, view):
        sells = self.exits(view, lambda a, p: (view.day - p.opened_on).days >= self.hold or view.marks.get(a, 0.0) >= p.avg_cost * self.take_profit)
        ranked = []
        for a, mark in self.fresh(view):
            if view.kind(a) == "single" and mark >= self.min_price and (past := view.past(a, self.window)) and mark / past - 1 <= -self.threshold:
                ranked.append((mark / past - 1, a))
        return sells + self.entries(view, sells, ranked)


class Momentum(Strategy):
    def scores(self, view) -> list:
        found = []
        for a, mark in view.marks.items():
            if view.kind(a) == "single" and mark >= self.min_price and (past := view.past(a, self.lookback)):
                found.append((1 - mark / past, a))
        return sorted(found)

    def orders(self, view):
        held = view.book.positions
        if held and (view.day - max(p.opened_on for p in held.values())).days < self.rebalance:
            return []
        target = [a for _, a in self.scores(view)[: self.top_n]]
        if not target:
            return []
        sells = [(a, -p.quantity) for a, p in sorted(held.items(), key=lambda x: x[0][0]) if a not in target]
        share = view.book.equity(view.marks) / len(target)
        wanted = [(a, math.floor(share / view.marks[a]) - (held[a].quantity if a in held else 0)) for a in sorted(target)]
        return sells + [x for x in wanted if x[1] > 0]


class CostAwareReversion(Strategy):
    costs = CostModel()  # the hurdle is that of the standard costs, whatever the run's

    def orders(self, view):
        sells = self.exits(view, lambda a, p: (view.day - p.opened_on).days >= self.max_hold or view.marks.get(a, 0.0) >= p.avg_cost * self.take_profit)
        ranked = []
        for a, mark in self.fresh(view):
            if mark >= self.min_price and (high := view.high(a, self.window)):
                fall = 1 - mark / high
                if fall >= self.threshold and high / mark - 1 >= self.costs.fee_rate + 2 * self.costs.shipping / mark + self.min_edge:
                    ranked.append((-fall, a))
        return sells + self.entries(view, sells, ranked)


STRATEGIES = {"buy-and-hold": BuyAndHold, "sealed-accumulation": SealedAccumulation, "dip-buyer": DipBuyer, "xs-momentum": Momentum, "cost-aware-reversion": CostAwareReversion}


def make_strategy(name: str, params: dict) -> Strategy:
    return STRATEGIES[name](**resolve(name, params))


