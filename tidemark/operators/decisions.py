"""Folds over signals: limits and cooldowns, trade decisions, and portfolios of one or many symbols with shared cash."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.bars import spread


@dataclass(frozen=True)
class Limits:
    daily: int = 3
    cooldown: float = 2 * 86_400.0
    consecutive: int = 3
    least: float = 0.3
    least_held: float = 0.5
    add: float = 0.7


@dataclass
class State:
    position: str = "flat"
    last: float | None = None
    day: int | None = None
    taken: int = 0
    side: str | None = None
    run: int = 0
    history: deque = field(default_factory=lambda: deque(maxlen=10))


def blocked(s: State, t: float, side: str, strength: float, lim: Limits) -> str | None:
    """The first filter that a signal doesn't pass: daily limit, cooldown, runs of one side, strength by position."""
    if s.day == t // 86_400 and s.taken >= lim.daily:
        return "daily"
    if s.last is not None and t - s.last < lim.cooldown:
        return "cooldown"
    if s.side == side and s.run >= lim.consecutive:
        return "consecutive"
    if strength < (lim.least if s.position == "flat" else lim.least_held):
        return "strength"
    return None


def action(position: str, side: str, strength: float, lim: Limits) -> str:
    """By position and side; a position is added to for strong signals only."""
    if position == "flat":
        return "BUY" if side == "BUY" else "SELL"
    if (position == "long") == (side == "BUY"):
        return ("ADD_LONG" if position == "long" else "ADD_SHORT") if strength > lim.add else "HOLD"
    return "CLOSE_LONG" if position == "long" else "CLOSE_SHORT"


def confidence(s: State, side: str, strength: float, top_share: float) -> float:
    """The strength, a tenth more if the last three signals agree and a tenth less if none does, and up to a fifth more by how much of the weight one
    component has; at most 1."""
    last = list(s.history)[-3:]
    factor = 1.1 if len(last) == 3 and all(x == side for x in last) else 0.9 if len(last) == 3 and side not in last else 1.0
    return min(1.0, strength * factor * (1 + 0.2 * max(0.0, top_share - 1 / 3) * 1.5))


def decide(times, sides, strengths, shares, lim: Limits) -> list[tuple[str, str | None, float]]:
    """(action, blocked by, confidence) of each signal in time order; HOLD signals pass without effect."""
    s, out = State(), []
    for t, side, x, share in zip(times, sides, strengths, shares):
        if side == "HOLD":
            out.append(("HOLD", None, 0.0))
            continue
        why = blocked(s, t, side, x, lim)
        act = "HOLD" if why else action(s.position, side, x, lim)
        out.append((act, why, confidence(s, side, x, share) if act != "HOLD" else 0.0))
        s.history.append(side)
        if act == "HOLD":
            continue
        s.taken = s.taken + 1 if s.day == t // 86_400 else 1
        s.day, s.last = t // 86_400, t
        s.run = s.run + 1 if s.side == side else 1
        s.side = side
        s.position = {"BUY": "long", "ADD_LONG": "long", "SELL": "short", "ADD_SHORT": "short"}.get(act, "flat")
    return out


def decisions(rows: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """rows(symbol, bar_ts, side, strength, top_share) -> (symbol, bar_ts, side, action, blocked, confidence)."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_ts")
        t = d.bar_ts.astype("datetime64[us]").astype("int64") / 1e6
        got = decide(t, d.side, d.strength, d.top_share, lim)
        return pd.DataFrame({"symbol": d.symbol, "bar_ts": d.bar_ts, "side": d.side, "action": [g[0] for g in got], "blocked": [g[1] for g in got], "confidence": [g[2] for g in got]})

    return spread(rows.select("symbol", "bar_ts", "side", "strength", "top_share"), "symbol").groupBy("symbol").applyInPandas(one, "symbol string, bar_ts timestamp, side string, action string, blocked string, confidence double")


class Portfolio:
    """Cash and positions at average cost. wrong_partial: a part that is closed has the wrong sign, and the rest is taken as entered at the new price."""

    def __init__(self, cash: float, wrong_partial: bool = False):
        self.cash, self.realised, self.paid, self.wrong = cash, 0.0, 0.0, wrong_partial
        self.held: dict[str, list[float]] = {}  # quantity and average entry
        self.prices: dict[str, float] = {}

    def trade(self, symbol: str, quantity: float, price: float, fee: float = 0.0) -> None:
        self.cash -= quantity * price + fee
        self.paid += fee
        have, entry = self.held.get(symbol, [0.0, 0.0])
        if have * quantity >= 0:
            new = have + quantity
            self.held[symbol] = [new, (abs(have) * entry + abs(quantity) * price) / abs(new)] if new else [0.0, 0.0]
        else:
            closed = min(abs(have), abs(quantity)) * (1 if have > 0 else -1)
            gain = closed * (price - entry)
            part = abs(quantity) < abs(have)
            self.realised += -gain if self.wrong and part else gain
            rest = have + quantity
            self.held[symbol] = [rest, price if rest * have < 0 or (self.wrong and part) else entry]
        if abs(self.held[symbol][0]) < 1e-12:
            del self.held[symbol]
        self.prices[symbol] = price

    def snapshot(self) -> tuple[float, float, float, int]:
        """(value, exposure, unrealised, positions)."""
        own = [(q, e, self.prices[s]) for s, (q, e) in self.held.items()]
        return self.cash + sum(q * p for q, _, p in own), sum(abs(q) * p for q, _, p in own), sum(q * (p - e) for q, e, p in own), len(own)

    def faults(self) -> list[str]:
        value, exposure, _, _ = self.snapshot()
        out = ["cash"] * (self.cash < 0) + ["quantity"] * any(q == 0 for q, _ in self.held.values()) + ["price"] * any(p <= 0 for p in self.prices.values())
        return out + ["leverage"] * (value > 0 and exposure / value > 3)


def shared_cash(rows: DataFrame, capital: float = 100_000.0, share: float = 0.02, fee: float = 0.001, run: str = "run_id") -> DataFrame:
    """rows(run_id, symbol, bar_ts, close, side) -> (run_id, bar_ts, cash, value, exposure, unrealised, realised, n_positions): all symbols of a run in time order, then by
    symbol, on one account: a snapshot each time. Cash is shared, so a run is one task's; runs are dealt over tasks."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna(subset=["close"]).sort_values(["bar_ts", "symbol"])
        p, out = Portfolio(capital), []
        for t, group in d.groupby("bar_ts", sort=True):
            for s, close, side in zip(group.symbol, group.close, group.side):
                p.prices[s] = close
            for s, close, side in zip(group.symbol, group.close, group.side):
                have = p.held.get(s, [0.0, 0.0])[0]
                if side == "BUY" and have <= 0 or side == "SELL" and have >= 0:
                    want = (1 if side == "BUY" else -1) * share * capital / close
                    if have:
                        p.trade(s, -have, close, fee * abs(have) * close)
                    elif p.cash >= share * capital:
                        p.trade(s, want, close, fee * abs(want) * close)
            out.append((d[run].iloc[0], t, p.cash, *p.snapshot()[:3], p.realised, len(p.held)))
        return pd.DataFrame(out, columns=[run, "bar_ts", "cash", "value", "exposure", "unrealised", "realised", "n_positions"])

    return spread(rows.select(run, "symbol", "bar_ts", "close", "side"), run).groupBy(run).applyInPandas(one, f"{run} string, bar_ts timestamp, cash double, value double, exposure double, unrealised double, realised double, n_positions int")
