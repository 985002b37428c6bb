"""Queries of costs. An order for each bar whose close moved over a tenth: bought after a fall, sold after a rise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import costs as C
from tidemark.plans.registry import W, r6, registered, rounded

ORDERS = f", g as (select *, close / nullif(lag(close) over ({W}), 0) - 1 as r from b), v as (select *, least(case when count(r) over w >= 10 then stddev_samp(r) over w * sqrt(252) else 0.15 end, 3) as vol from g window w as ({W} rows between 9 preceding and current row)), o as (select symbol, bar_ts, case when r < 0 then 'BUY' else 'SELL' end as side, case when r < 0 then 2.0 else 1.5 end as quantity, close as price, case when day(bar_ts) % 5 = 0 then null else volume end as volume, vol, case when volume <= 0 or day(bar_ts) % 5 = 0 then 0.01 else (case when r < 0 then 2.0 else 1.5 end) / volume end as p from v where abs(r) > 0.1)"
COSTS = ORDERS + ", n as (select *, quantity * price as notional from o), k as (select *, greatest(notional * 0.001, 1) as commission, notional * (case symbol when '1' then 0.0005 else 0.0001 end) as spread_cost, notional * 0.1 * p as impact, notional * (0.05 * p + 0.02 * sqrt(p)) * greatest(1, vol / 0.15) as slippage from n), c as (select *, commission + spread_cost + impact + slippage as total from k)"
RATES = C.Rates(spreads={"1": 0.0005})


def orders(b):
    moved = F.col("close") / F.nullif(B.back("close"), F.lit(0.0)) - 1
    d = b.select("symbol", "bar_ts", moved.alias("r")).where(F.abs("r") > 0.1)
    d = d.select("symbol", "bar_ts", F.when(F.col("r") < 0, "BUY").otherwise("SELL").alias("side"), F.when(F.col("r") < 0, 2.0).otherwise(1.5).alias("quantity"))
    return C.priced(d, b, 10).withColumn("volatility", F.least("volatility", F.lit(3.0))).withColumn("volume", F.expr("case when day(bar_ts) % 5 = 0 then null else volume end"))


@registered(COSTS + " select symbol, bar_ts, side, round(notional, 6) as notional, round(commission, 6) as commission, round(spread_cost, 6) as spread_cost, round(impact, 6) as impact, round(slippage, 6) as slippage, round(total, 6) as total, round(total / nullif(notional, 0) * 10000, 4) as bps, round(price + (case side when 'BUY' then 1 else -1 end) * (impact + slippage) / quantity, 6) as execution_price from c")
def trade_costs(b):
    d = C.trade_costs(orders(b), RATES)
    return d.select("symbol", "bar_ts", "side", *r6(notional="notional", commission="commission", spread_cost="spread_cost", impact="impact", slippage="slippage", total="total"), *rounded(4, bps="bps"), *r6(execution_price="execution_price"))


@registered(ORDERS + ", s as (select *, greatest(1, vol / 0.15) as m from o), x as (select symbol, bar_ts, side, quantity, price, unnest([{'model': 'linear', 'share': 0.05 * p}, {'model': 'sqrt', 'share': 0.02 * sqrt(p)}, {'model': 'combined', 'share': 0.05 * p + 0.02 * sqrt(p)}, {'model': 'volatility_adjusted', 'share': (0.05 * p + 0.02 * sqrt(p)) * m * m}]) as x from s) select symbol, bar_ts, x.model as model, round(x.share, 6) as share, round(quantity * price * x.share, 6) as cost, round(x.share * 10000, 4) as bps, round(price * (1 + (case side when 'BUY' then 1 else -1 end) * x.share), 6) as execution_price from x")
def slippage_models(b):
    return C.compared_models(orders(b)).select("symbol", "bar_ts", "model", *r6(share="share", cost="cost"), *rounded(4, bps="bps"), *r6(execution_price="execution_price"))


_parts = ", ".join(f"round(sum({c}), 4) as {c}, round(sum({c}) / nullif(sum(total), 0), 6) as {c}_share" for c in C.PARTS)


@registered(COSTS + f" select symbol, count(*) as n, round(sum(notional), 4) as notional, {_parts}, round(sum(total), 4) as total, round(avg(total), 6) as mean, round(sum(total) / nullif(sum(notional), 0) * 10000, 4) as bps from c group by rollup (symbol)")
def cost_by_symbol(b):
    d = C.breakdown(C.trade_costs(orders(b), RATES))
    return d.select("symbol", "n", *rounded(4, **{c: c for c in ("notional", *C.PARTS, "total", "bps")}), *r6(mean="mean", **{f"{c}_share": f"{c}_share" for c in C.PARTS}))


_sizes = {"fixed": "1000 * conf", "percentage": "100000 * 0.05 * conf", "volatility": "case when vol > 0 then 100000 * 0.15 / vol * conf else 100000 * 0.05 * conf end", "kelly": "greatest((2 * conf - (1 - conf)) / 2, 0) * 0.25 * 100000"}


@registered(ORDERS + ", s as (select *, least(vol, 1) as conf from o), x as (select symbol, bar_ts, side, price, unnest([" + ", ".join(f"{{'method': '{m}', 'size': {x}}}" for m, x in _sizes.items()) + "]) as x from s) select symbol, bar_ts, x.method as method, round(x.size, 4) as size, case when x.size > 10000 then 'position' when 95000 + x.size > 100000 then 'exposure' when x.size < 10 then 'small' end as fault, side as order_side, round(case when price > 0 then x.size / price else 0 end, 4) as quantity, round(3.0, 1) as closing from x")
def position_sizes(b):
    """Four methods for each order, its risk check in a portfolio of 100,000 of which 95,000 are in use, and the quantity; closing is the quantity that
    would close a short position of 3."""
    d = orders(b).withColumn("conf", F.least("volatility", F.lit(1.0)))
    d = d.withColumn("method", F.explode(F.array(*map(F.lit, _sizes))))
    d = d.withColumn("size", C.position_size(F.col("method"), F.lit(100_000.0), F.col("conf"), F.col("volatility")))
    action = F.col("side")
    closing = C.order_quantity(F.lit("CLOSE_SHORT"), F.col("size"), F.col("price"), F.lit(-3.0))
    return d.select("symbol", "bar_ts", "method", *rounded(4, size="size"), C.risk_fault(F.col("size"), F.lit(100_000.0), F.lit(95_000.0)).alias("fault"), C.order_side(action).alias("order_side"), *rounded(4, quantity=C.order_quantity(action, F.col("size"), F.col("price"), F.lit(0.0))), F.round(closing, 1).alias("closing"))
