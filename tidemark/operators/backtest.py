"""Backtest of one symbol's sides as a fold in time order, with costs charged to cash."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.bars import spread


@dataclass(frozen=True)
class Costs:
    commission: float = 0.001
    least: float = 1.0
    slippage: float = 0.0005


def folded(close: np.ndarray, side: list[str], capital: float, fraction: float, costs: Costs) -> dict[str, np.ndarray]:
    """A side other than HOLD turns the position to the given fraction of the value, long or short; a snapshot each bar."""
    cash, held, paid = capital, 0.0, 0.0
    out = {k: np.empty(len(close)) for k in ("cash", "position", "value", "cost")}
    for t, (price, s) in enumerate(zip(close, side)):
        if s != "HOLD" and price > 0:
            want = (1 if s == "BUY" else -1) * fraction * max(cash + held * price, 0.0) / price
            if np.sign(want) != np.sign(held):
                change = want - held
                fee = max(costs.least, abs(change) * price * costs.commission) + abs(change) * price * costs.slippage
                cash, held, paid = cash - change * price - fee, want, paid + fee
        out["cash"][t], out["position"][t], out["value"][t], out["cost"][t] = cash, held, cash + held * price, paid
    return out


def run(rows: DataFrame, capital: float = 500_000.0, fraction: float = 0.05, costs: Costs = Costs()) -> DataFrame:
    """rows(symbol, bar_ts, close, side) -> snapshots (symbol, bar_ts, cash, position, value, cost), an account per symbol."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna(subset=["close"]).sort_values("bar_ts")
        return pd.DataFrame({"symbol": d.symbol, "bar_ts": d.bar_ts, **folded(d.close.to_numpy(float), d.side.tolist(), capital, fraction, costs)})

    return spread(rows.select("symbol", "bar_ts", "close", "side"), "symbol").groupBy("symbol").applyInPandas(one, "symbol string, bar_ts timestamp, cash double, position double, value double, cost double")
