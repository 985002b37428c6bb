"""Fusion of component signals into a score and a side, and the cooldown between emitted signals."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import spread


def squash(x: Column) -> Column:
    return x / (1 + F.abs(x))


def score(weights: dict[str, float]) -> Column:
    """Weighted sum of the named columns, weights divided by the sum of their absolute values; null if a component is."""
    total = sum(map(abs, weights.values()))
    if not total:
        raise ValueError("all weights are zero")
    parts = [F.col(c) * (w / total) for c, w in weights.items()]
    return sum(parts[1:], parts[0])


def side(x: Column, threshold: float) -> Column:
    return F.when(x > threshold, "BUY").when(x < -threshold, "SELL").otherwise("HOLD")


def emitted(times: Iterable[float], sides: Iterable[str], period: float) -> list[bool]:
    """Which signals leave: not HOLD, and at least period seconds after the last that left."""
    out, last = [], None
    for t, s in zip(times, sides):
        go = s != "HOLD" and (last is None or t - last >= period)
        last = t if go else last
        out.append(go)
    return out


def cooled(rows: DataFrame, period: float) -> DataFrame:
    """rows(symbol, bar_ts, side) -> the same with emit. Greedy, so one pass over each symbol's rows in time order."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_ts")
        return d.assign(emit=emitted(d.bar_ts.astype("datetime64[us]").astype("int64") / 1e6, d.side, period))

    return spread(rows.select("symbol", "bar_ts", "side"), "symbol").groupBy("symbol").applyInPandas(one, "symbol string, bar_ts timestamp, side string, emit boolean")
