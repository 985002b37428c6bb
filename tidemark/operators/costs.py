"""Costs of orders: commission, spread, impact, slippage in several models, sizes of positions and quantities of orders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bars as B


@dataclass(frozen=True)
class Rates:
    commission: float = 0.001
    least: float = 1.0
    spread: float = 1e-4
    spreads: dict[str, float] = field(default_factory=dict)
    impact: float = 0.1
    linear: float = 0.05
    root: float = 0.02
    unknown: float = 0.01
    usual_volatility: float = 0.15


def participation(quantity: Column, volume: Column, unknown: float = 0.01) -> Column:
    """The order's share of the bar's volume; a fixed one where the volume is missing or 0."""
    return F.when(volume.isNull() | (volume <= 0), unknown).otherwise(F.abs(quantity) / volume)


def commission(notional: Column, r: Rates) -> Column:
    return F.greatest(notional * r.commission, F.lit(r.least))


def spread(symbol: Column, notional: Column, r: Rates) -> Column:
    rate = F.lit(r.spread)
    for s, v in sorted(r.spreads.items()):
        rate = F.when(symbol == s, v).otherwise(rate)
    return notional * rate


def volatility(n: int = 20, per_year: float = 252.0, default: float = 0.15) -> Column:
    """Of the last n returns up to the bar itself, a year's; the default before there are n."""
    return F.when(F.count("_r").over(B.last(n)) >= n, F.stddev_samp("_r").over(B.last(n)) * F.sqrt(F.lit(per_year))).otherwise(default)


def priced(orders: DataFrame, bars: DataFrame, n: int = 20) -> DataFrame:
    """orders(symbol, bar_ts, side, quantity) with price, volume and volatility of their bar: an equal join of symbol and time, with the
    volatility known at the bar, not after it."""
    v = bars.withColumn("_r", F.col("close") / F.nullif(B.back("close"), F.lit(0.0)) - 1).select("symbol", "bar_ts", F.col("close").alias("price"), F.col("volume"), volatility(n).alias("volatility"))
    return orders.join(v, ["symbol", "bar_ts"], "left").withColumn("volatility", F.coalesce("volatility", F.lit(0.15)))


def trade_costs(orders: DataFrame, r: Rates = Rates()) -> DataFrame:
    """orders(symbol, side, quantity, price, volume, volatility) with notional, the four costs, total, bps and execution_price, which is worse
    than the price by impact and slippage."""
    d = orders.withColumn("notional", F.abs("quantity") * F.col("price")).withColumn("_p", participation(F.col("quantity"), F.col("volume"), r.unknown))
    slip = F.col("notional") * (r.linear * F.col("_p") + r.root * F.sqrt("_p")) * F.greatest(F.lit(1.0), F.col("volatility") / r.usual_volatility)
    d = d.withColumns({"commission": commission(F.col("notional"), r), "spread_cost": spread(F.col("symbol"), F.col("notional"), r), "impact": F.col("notional") * r.impact * F.col("_p"), "slippage": slip})
    d = d.withColumn("total", F.col("commission") + F.col("spread_cost") + F.col("impact") + F.col("slippage"))
    each = (F.col("impact") + F.col("slippage")) / F.nullif(F.abs("quantity"), F.lit(0.0))
    return d.withColumns({"bps": F.col("total") / F.nullif("notional", F.lit(0.0)) * 10_000, "execution_price": F.when(F.col("side") == "BUY", F.col("price") + each).otherwise(F.col("price") - each)}).drop("_p")


def slippage_share(model: str, p: Column, vol: Column, r: Rates = Rates(), doubled: bool = True) -> Column:
    """The share of the price that an order loses under a model: linear, sqrt, combined, or adjusted by volatility, where with doubled the
    factor m weighs the sum and (m - 1) times the weighed sum is added."""
    lin, root = r.linear * p, r.root * F.sqrt(p)
    m = F.greatest(F.lit(1.0), vol / r.usual_volatility)
    adjusted = (lin + root) * m
    return {"linear": lin, "sqrt": root, "combined": lin + root, "volatility_adjusted": adjusted + (m - 1) * adjusted if doubled else adjusted}[model]


MODELS = ("linear", "sqrt", "combined", "volatility_adjusted")


def compared_models(orders: DataFrame, r: Rates = Rates()) -> DataFrame:
    """A row for each order and model: share, cost, bps and execution_price."""
    p = participation(F.col("quantity"), F.col("volume"), r.unknown)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), slippage_share(m, p, F.col("volatility"), r).alias("share")) for m in MODELS])
    d = orders.withColumn("x", F.explode(rows)).select("*", "x.*").drop("x")
    turn = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    return d.withColumns({"cost": F.abs("quantity") * F.col("price") * F.col("share"), "bps": F.col("share") * 10_000, "execution_price": F.col("price") * (1 + turn * F.col("share"))})


PARTS = ("commission", "spread_cost", "impact", "slippage")


def breakdown(costs: DataFrame, keys=("symbol",)) -> DataFrame:
    """(keys, n, notional, of each part: total, share; total, mean, bps) of costs; rolled up, so that a row without key holds all."""
    d = costs.rollup(*keys).agg(F.count("*").alias("n"), F.sum("notional").alias("notional"), *[F.sum(c).alias(c) for c in PARTS], F.sum("total").alias("total"), F.avg("total").alias("mean"))
    return d.withColumns({f"{c}_share": F.col(c) / F.nullif("total", F.lit(0.0)) for c in PARTS} | {"bps": F.col("total") / F.nullif("notional", F.lit(0.0)) * 10_000})


def position_size(method: Column, value: Column, confidence: Column, vol: Column, fixed: float = 1000.0, pct: float = 0.05, target: float = 0.15) -> Column:
    """Money for a position: fixed, a percentage of the portfolio's value, by target over volatility (percentage where it is 0), or a quarter of
    Kelly's share, where the confidence is the chance to win twice the stake's loss."""
    percentage = value * pct * confidence
    kelly = F.greatest((2 * confidence - (1 - confidence)) / 2, F.lit(0.0)) * 0.25 * value
    return F.when(method == "fixed", fixed * confidence).when(method == "percentage", percentage).when(method == "volatility", F.when(vol > 0, value * target / vol * confidence).otherwise(percentage)).when(method == "kelly", kelly)


def risk_fault(size: Column, value: Column, exposure: Column, most: float = 0.1, most_exposure: float = 1.0, least: float = 10.0) -> Column:
    """The first rule that a position breaks, or null."""
    return F.when(value <= 0, "no value").when(size > most * value, "position").when(exposure + size > most_exposure * value, "exposure").when(size < least, "small")


def order_side(action: Column) -> Column:
    return F.when(action.isin("BUY", "CLOSE_SHORT", "ADD_LONG"), "BUY").when(action.isin("SELL", "CLOSE_LONG", "ADD_SHORT"), "SELL")


def order_quantity(action: Column, size: Column, price: Column, position: Column) -> Column:
    return F.when(action.startswith("CLOSE"), F.abs(position)).when(price > 0, size / price).otherwise(0.0)
