"""Trades of a strategy on one symbol at a time, and what is told of trades and equity: attribution, streaks, drawdowns, returns, risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import corr, divided, spread


@dataclass(frozen=True)
class Plan:
    capital: float = 100_000.0
    size: float = 0.1
    threshold: float = 0.5
    confidence: float = 0.3
    stop_loss: float = 0.05
    take_profit: float = 0.1
    least_hours: float = 24.0
    most_hours: float = 240.0
    cost: float = 0.001
    slippage: float = 0.0005


TRADE = "symbol string, entry_time timestamp, exit_time timestamp, direction int, entry_price double, exit_price double, quantity double, pnl double, strength double, hours double, reason string"


def unrealised(direction: float, entry: float, quantity: float, price: float) -> float:
    return direction * (price - entry) * quantity


def realised(direction: float, entry: float, quantity: float, price: float, p: Plan) -> float:
    """The exit slips against the position, and both sides pay the cost."""
    out = price * (1 - direction * p.slippage)
    return direction * (out - entry) * quantity - (entry + out) * quantity * p.cost


def exit_reason(direction: int, entry: float, price: float, hours: float, signal: float, p: Plan) -> str | None:
    """Stop loss, take profit, longest holding, then a strong opposite signal after the shortest holding."""
    gain = direction * (price / entry - 1)
    if gain <= -p.stop_loss:
        return "StopLoss"
    if gain >= p.take_profit:
        return "TakeProfit"
    if hours >= p.most_hours:
        return "MaxHoldingPeriod"
    if hours >= p.least_hours and signal * direction < 0 and abs(signal) >= p.threshold:
        return "OppositeSignal"
    return None


def fold(symbol: str, t: np.ndarray, close: np.ndarray, signal: np.ndarray, confidence: np.ndarray, p: Plan) -> tuple[list[tuple], list[tuple]]:
    """(trades, equity points) of a series: first exits, then entries, one position at a time; what is left is closed at the end. t: in seconds."""
    trades, equity, held = [], [], None
    cash, top, stake = p.capital, -np.inf, p.capital * p.size

    def close_it(i: int, reason: str) -> None:
        nonlocal cash, held
        d, entry, at, q, s = held
        pnl = realised(d, entry, q, close[i], p)
        cash += stake + pnl
        trades.append((symbol, at, t[i], d, entry, close[i], q, pnl, s, (t[i] - at) / 3600, reason))
        held = None

    for i in range(len(t)):
        if held and (why := exit_reason(held[0], held[1], close[i], (t[i] - held[2]) / 3600, signal[i], p)):
            close_it(i, why)
        if not held and abs(signal[i]) >= p.threshold and confidence[i] >= p.confidence and cash >= stake and close[i] > 0:
            entry = close[i] * (1 + p.slippage)
            held = (1 if signal[i] > 0 else -1, entry, t[i], stake / entry, signal[i])
            cash -= stake
        value = unrealised(held[0], held[1], held[3], close[i]) + held[3] * held[1] if held else 0.0
        top = max(top, cash + value)
        equity.append((symbol, t[i], cash + value, (top - cash - value) / top if top > 0 else 0.0, cash, value))
    if held:
        close_it(len(t) - 1, "EndOfData")
    return trades, equity


def run(rows: DataFrame, p: Plan = Plan(), what: str = "trades") -> DataFrame:
    """rows(symbol, bar_ts, close, signal, confidence) -> the trades, or the equity points (symbol, bar_ts, equity, drawdown, cash, value)."""
    schema = TRADE if what == "trades" else "symbol string, bar_ts timestamp, equity double, drawdown double, cash double, value double"

    def one(d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna(subset=["close", "signal", "confidence"]).sort_values("bar_ts")
        t = d.bar_ts.astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        got = fold(str(d.symbol.iloc[0]) if len(d) else "", t, *(d[c].to_numpy(float) for c in ("close", "signal", "confidence")), p)[what != "trades"]
        names = [x.split()[0] for x in schema.split(", ")]
        out = pd.DataFrame(got, columns=names)
        for c in names:
            if c.endswith("time") or c == "bar_ts":
                out[c] = (out[c].to_numpy(float) * 1e6).round().astype("int64").astype("datetime64[us]")
        return out

    return spread(rows.select("symbol", "bar_ts", "close", "signal", "confidence"), "symbol").groupBy("symbol").applyInPandas(one, schema)


def attribution(trades: DataFrame) -> DataFrame:
    """(kind, label, n, pnl): by direction, by strength of the signal, by reason and by hours held, in one pass."""
    s = F.abs("strength")
    kinds = {
        "direction": F.when(F.col("direction") > 0, "long").otherwise("short"), "strength": F.when(s >= 0.7, "strong").when(s >= 0.3, "medium").otherwise("weak"),
        "reason": F.col("reason"), "held": F.when(F.col("hours") < 4, "short").when(F.col("hours") < 24, "day").otherwise("long"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("label")) for k, x in kinds.items()]))
    return trades.select("pnl", rows.alias("x")).groupBy("x.kind", "x.label").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


def analysis(trades: DataFrame, keys=()) -> DataFrame:
    """(keys, n, wins, losses, win_rate, mean_win, mean_loss, best, worst, profit_factor, expectancy, hours_corr, strength_corr)."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(win).alias("wins"), F.count(loss).alias("losses"), (F.count(win) / F.count("*")).alias("win_rate"), F.avg(win).alias("mean_win"), F.avg(loss).alias("mean_loss"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"),
        (F.sum(win) / F.nullif(-F.sum(loss), F.lit(0.0))).alias("profit_factor"), F.avg("pnl").alias("expectancy"), zero(corr("pnl", "hours")).alias("hours_corr"), zero(corr("pnl", F.abs("strength"))).alias("strength_corr"),
    )


def streaks(trades: DataFrame, keys=("symbol",), order: str = "exit_time") -> DataFrame:
    """(keys, most_wins, most_losses): the longest runs; a trade without gain or loss ends both."""
    sign, w = F.signum("pnl"), Window.partitionBy(*keys).orderBy(order)
    d = trades.select(*keys, order, sign.alias("s")).withColumn("turn", F.when(F.col("s") == F.lag("s").over(w), 0).otherwise(1)).withColumn("run", F.sum("turn").over(w))
    runs = d.groupBy(*keys, "run", "s").agg(F.count("*").alias("n"))
    longest = lambda v: F.coalesce(F.max(F.when(F.col("s") == v, F.col("n"))), F.lit(0))
    return runs.groupBy(*keys).agg(longest(1).alias("most_wins"), longest(-1).alias("most_losses"))


def drawdown_periods(equity: DataFrame, value: str = "equity", keys=("symbol",), order: str = "bar_ts", last_depth: bool = False) -> DataFrame:
    """(keys, start_time, end_time, seconds, bars, depth, recovered): runs below the peak so far; they end where a new peak is reached. depth is the
    largest share lost, or with last_depth that of the last bar before the end."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = equity.select(*keys, order, F.col(value).alias("v")).withColumn("peak", F.max("v").over(w))
    d = d.withColumn("under", F.col("v") < F.col("peak")).withColumn("period", F.sum(F.when(F.col("v") == F.col("peak"), F.when(F.col("peak") > F.coalesce(F.lag("peak").over(w), F.lit(-1e300)), 1).otherwise(0)).otherwise(0)).over(w))
    d = d.withColumn("lost", divided(F.col("peak") - F.col("v"), "peak"))
    under = F.when(F.col("under"), F.col(order))
    runs = d.groupBy(*keys, "period").agg(F.min(under).alias("start_time"), F.max(order).alias("last_ts"), F.count_if("under").alias("bars"), (F.max_by("lost", order) if last_depth else F.max("lost")).alias("depth"), F.min(order).alias("first_ts"))
    runs = runs.withColumn("next_ts", F.lead("first_ts").over(Window.partitionBy(*keys).orderBy("period")))
    out = runs.where("start_time is not null").withColumn("recovered", F.col("next_ts").isNotNull()).withColumn("end_time", F.coalesce("next_ts", "last_ts"))
    return out.select(*keys, "start_time", "end_time", (F.unix_timestamp("end_time") - F.unix_timestamp("start_time")).alias("seconds"), "bars", "depth", "recovered")


def performance(equity: DataFrame, value: str = "equity", keys=("symbol",), order: str = "bar_ts", per_year: float = 252.0, risk_free: float = 0.02) -> DataFrame:
    """(keys, n, total_return, annual_log, annual_return, volatility, sharpe, population_sharpe, sortino, calmar, max_drawdown, var_95, cvar_95) of a series of values.
    Quantiles interpolate; they come from a bounded sketch of a group's returns unless it has few."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = equity.select(*keys, order, F.col(value).alias("v")).withColumn("r", F.col("v") / F.nullif(F.lag("v").over(w), F.lit(0.0)) - 1).withColumn("dd", divided("v", F.max("v").over(w)) - 1)
    root, r = per_year**0.5, F.col("r")
    cut = F.percentile("r", 0.05)
    d = d.join(d.groupBy(*keys).agg(cut.alias("var_95")), list(keys))
    days = F.datediff(F.max(order), F.min(order))
    total = divided(F.max_by("v", order), F.min_by("v", order)) - 1
    out = d.groupBy(*keys, "var_95").agg(
        F.count("*").alias("n"), total.alias("total_return"), F.when((days > 0) & (total > -1), F.log(1 + total) * 365.25 / days).alias("annual_log"), (F.stddev_samp(r) * root).alias("volatility"),
        F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.stddev_pop(r).alias("_p"), F.stddev_samp(F.when(r < 0, r)).alias("_down"), F.min("dd").alias("max_drawdown"), F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"),
    )
    nz = lambda x: F.nullif(x, F.lit(0.0))
    out = out.withColumn("annual_return", F.expm1("annual_log"))
    return out.withColumns({"sharpe": (F.col("_m") * per_year - risk_free) / nz(F.col("_s") * root), "population_sharpe": (F.col("_m") * per_year - risk_free) / nz(F.col("_p") * root), "sortino": (F.col("_m") * per_year - risk_free) / nz(F.col("_down") * root), "calmar": F.col("annual_return") / nz(F.abs("max_drawdown"))}).drop("_m", "_s", "_p", "_down")


def stop_loss_hit(direction: Column, entry: Column, price: Column, share: float) -> Column:
    return direction * (price / entry - 1) <= -share


def take_profit_hit(direction: Column, entry: Column, price: Column, share: float) -> Column:
    return direction * (price / entry - 1) >= share


def round_trips(orders: DataFrame, keys=("symbol",), shorts: bool = True) -> DataFrame:
    """orders(symbol, bar_ts, side, quantity, price) -> (symbol, entry_time, exit_time, direction, quantity, entry_price, exit_price, pnl): what each
    order closes of a position at average cost. Without shorts, covered short positions aren't told."""

    def one(d: pd.DataFrame) -> pd.DataFrame:
        held = mean = 0.0
        since, out = None, []
        for t, side, q, price in zip(d.bar_ts, d.side, d.quantity, d.price) if not (d := d.sort_values(["bar_ts", "side"])).empty else ():
            q = q if side == "BUY" else -q
            if held * q < 0:
                n, sign = min(abs(q), abs(held)), 1 if held > 0 else -1
                if shorts or sign > 0:
                    out.append((d.symbol.iloc[0], since, t, sign, n, mean, price, sign * (price - mean) * n))
                q += sign * n
                held -= sign * n
                if abs(held) < 1e-12:
                    held = 0.0
            if q:
                since = t if not held else since
                mean = (abs(held) * mean + abs(q) * price) / (abs(held) + abs(q))
                held += q
        return pd.DataFrame(out, columns=["symbol", "entry_time", "exit_time", "direction", "quantity", "entry_price", "exit_price", "pnl"])

    return spread(orders.select("symbol", "bar_ts", "side", "quantity", "price"), *keys).groupBy(*keys).applyInPandas(one, "symbol string, entry_time timestamp, exit_time timestamp, direction int, quantity double, entry_price double, exit_price double, pnl double")
