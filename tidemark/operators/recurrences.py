"""Recurrences that a bounded frame can't express: one pass over each symbol's rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.bars import spread


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def trailing(x: np.ndarray, n: int) -> np.ndarray:
    """Means of the last n values, added oldest first, so that equal ones compare as equal; undefined before there are n."""
    total = np.zeros(max(len(x) - n + 1, 0))
    for k in range(n):
        total += x[k : k + len(total)]
    return np.concatenate((np.full(len(x) - len(total), np.nan), total / n))


def share(a: np.ndarray, b: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """100 a / b, 0 where b is not over least."""
    return np.where(b > least, 100 * a / np.where(b > least, b, 1.0), 0.0)


def movements(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(true range, upward and downward movement) of each bar; the first one has its own range and no movement."""
    before = np.concatenate((close[:1], close[:-1]))
    tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    tr[:1] = (high - low)[:1]
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    return tr, np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    """Average directional index of smoothing 1 / n; undefined for n - 1 bars, which count as 0 in the last smoothing."""
    tr, plus, minus = (ewm(x, 1 / n) for x in movements(high, low, close))
    plus, minus = share(plus, tr), share(minus, tr)
    dx = share(np.abs(plus - minus), plus + minus)
    dx[: n - 1] = 0.0
    out = ewm(dx, 1 / n)
    out[: n - 1] = np.nan
    return out


def recurrent(bars: DataFrame, ma: int = 20, period: int = 14) -> DataFrame:
    """(symbol, bar_ts, ema, rsi, wt1, wt2, adx). A symbol's series is one task's: it is sequential, and narrow."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_ts")
        high, low, c = (d[x].to_numpy(float) for x in ("high", "low", "close"))
        move = np.diff(c, prepend=c[:1])
        up, down = ewm(np.maximum(move, 0), 1 / period), ewm(np.maximum(-move, 0), 1 / period)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(down <= 1e-10, 100.0, 100 - 100 / (1 + up / down))
            tp = (high + low + c) / 3
            esa = ewm(tp, 2 / (ma + 1))
            dev = ewm(np.abs(tp - esa), 2 / (ma + 1))
            ci = np.where(dev <= 1e-8, 0.0, (tp - esa) / (0.015 * dev))
        wt1 = ewm(ci, 2 / (period + 1))
        return pd.DataFrame({"symbol": d.symbol, "bar_ts": d.bar_ts, "ema": ewm(c, 2 / (ma + 1)), "rsi": rsi, "wt1": wt1, "wt2": ewm(wt1, 0.4), "adx": adx(high, low, c, ma)})

    return spread(bars.select("symbol", "bar_ts", "high", "low", "close"), "symbol").groupBy("symbol").applyInPandas(one, "symbol string, bar_ts timestamp, ema double, rsi double, wt1 double, wt2 double, adx double")


def filters(bars: DataFrame, length: int = 14, short: int = 1, long: int = 10, adx_least: float = 20.0, slope_least: float = -0.1, corrected: bool = True) -> DataFrame:
    """(symbol, bar_ts, volatile, trending, sloped, passed): whether the last short true ranges are larger in the mean than the
    last long ones (yes before there are enough), whether the directional index of smoothed sums is over adx_least, and whether the
    curve of an adaptive average declines no faster than usual. Without corrected, the slope is taken between a value and itself,
    so that it is undefined and never enough."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_ts")
        high, low, c = (d[x].to_numpy(float) for x in ("high", "low", "close"))
        before = np.concatenate((c[:1], c[:-1]))
        ph, pl = np.concatenate((high[:1], high[:-1])), np.concatenate((low[:1], low[:-1]))
        tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        a, b = trailing(tr, short), trailing(tr, long)
        volatile = np.isnan(b) | (a > b)
        up, down = high - ph, pl - low
        sums = [ewm(np.concatenate(([0.0], x)), 1 / length)[1:] for x in (tr, np.where(up > down, np.maximum(up, 0), 0), np.where(down > up, np.maximum(down, 0), 0))]
        plus, minus = sums[1] / np.where(sums[0] > 0, sums[0], np.nan), sums[2] / np.where(sums[0] > 0, sums[0], np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            dx = 100 * np.abs(plus - minus) / (plus + minus)
        v1 = v2 = curve = mean = 0.0
        sloped = np.zeros(len(c), bool)
        for t in range(len(c)):
            v1, v2 = 0.2 * (c[t] - before[t]) + 0.8 * v1, 0.1 * (high[t] - low[t]) + 0.8 * v2
            w = abs(v1 / v2) if v2 else 0.0
            alpha = (-(w**2) + np.sqrt(w**4 + 16 * w**2)) / 8
            new = alpha * c[t] + (1 - alpha) * curve
            slope = abs(new - curve) if corrected else 0.0
            curve, mean = new, 2 / 201 * slope + 199 / 201 * mean
            sloped[t] = mean > 0 and (slope - mean) / mean >= slope_least
        trending = np.nan_to_num(dx) > adx_least
        return pd.DataFrame({"symbol": d.symbol, "bar_ts": d.bar_ts, "volatile": volatile, "trending": trending, "sloped": sloped, "passed": volatile & trending & sloped})

    return spread(bars.select("symbol", "bar_ts", "high", "low", "close"), "symbol").groupBy("symbol").applyInPandas(one, "symbol string, bar_ts timestamp, volatile boolean, trending boolean, sloped boolean, passed boolean")
