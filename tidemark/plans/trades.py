"""Queries of trades. The signal of a bar is its turned and squashed z-score of ten bars, the confidence 1 / (1 + its size / 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import trades as T
from tidemark.plans import costs
from tidemark.plans.registry import W, r6, registered, rounded

P = T.Plan()
_w10 = f"({W} rows between 9 preceding and current row)"
SIGNALS = f", g as (select symbol, bar_ts, close, (close - avg(close) over {_w10}) / nullif(stddev_samp(close) over {_w10}, 0) as z from b), x as (select symbol, bar_ts, epoch(bar_ts) as t, close, round(-z / (1 + abs(z)), 9) as signal, round(1 / (1 + abs(z) / 2), 9) as confidence, row_number() over ({W}) as i, count(*) over (partition by symbol) as n from g where z is not null)"
_gain = "s.d * (x.close / s.entry - 1)"
_hours = "(x.t - s.ent) / 3600"
_why = f"case when s.d = 0 then null when {_gain} <= -{P.stop_loss} then 'StopLoss' when {_gain} >= {P.take_profit} then 'TakeProfit' when {_hours} >= {P.most_hours} then 'MaxHoldingPeriod' when {_hours} >= {P.least_hours} and x.signal * s.d < 0 and abs(x.signal) >= {P.threshold} then 'OppositeSignal' end"
_out = f"(x.close * (1 - y.d * {P.slippage}))"
_stake = P.capital * P.size
#: A state a bar: position after it (d, entry, at, q, strength), cash, and what it closed.
FOLD = f"""{SIGNALS}, s as (
select symbol, 0::bigint as i, 0 as d, 0.0::double as entry, 0.0::double as ent, 0.0::double as q, 0.0::double as strength, {P.capital}::double as cash, null::varchar as why, 0 as xd, 0.0::double as xentry, 0.0::double as xat, 0.0::double as xq, 0.0::double as xs, 0.0::double as pnl from (select distinct symbol from x)
union all
select symbol, i, case when go then side else kd end, case when go then price else kentry end, case when go then t else kat end, case when go then {_stake} / price else kq end, case when go then signal else ks end, case when go then kcash - {_stake} else kcash end, why, xd, xentry, xat, xq, xs, pnl from (
 select *, case when signal > 0 then 1 else -1 end as side, close * (1 + {P.slippage}) as price, kd = 0 and abs(signal) >= {P.threshold} and confidence >= {P.confidence} and kcash >= {_stake} and close > 0 as go from (
  select y.symbol, y.i, y.t, y.close, y.signal, y.confidence, y.why, y.d as xd, y.entry as xentry, y.ent as xat, y.q as xq, y.strength as xs, case when y.why is null then y.d else 0 end as kd, y.entry as kentry, y.ent as kat, y.q as kq, y.strength as ks, y.pnl, case when y.why is null then y.cash else y.cash + {_stake} + y.pnl end as kcash from (
   select s.symbol, x.i, x.t, x.close, x.signal, x.confidence, s.d, s.entry, s.ent, s.q, s.strength, s.cash, {_why} as why, s.d * (x.close * (1 - s.d * {P.slippage}) - s.entry) * s.q - (s.entry + x.close * (1 - s.d * {P.slippage})) * s.q * {P.cost} as pnl from s join x on s.symbol = x.symbol and x.i = s.i + 1) y))),
f as (select s.*, x.t, x.close, x.bar_ts, x.n from s join x using (symbol, i)),
trades as (select symbol, xat as ent, t, xd as d, xentry as entry, close, xq as q, pnl, xs as strength, why from f where why is not null
 union all select symbol, ent, t, d, entry, close, q, d * (close * (1 - d * {P.slippage}) - entry) * q - (entry + close * (1 - d * {P.slippage})) * q * {P.cost}, strength, 'EndOfData' from f where i = n and d <> 0),
tr as (select symbol, make_timestamp((ent * 1000000)::bigint) as entry_time, make_timestamp((t * 1000000)::bigint) as exit_time, d as direction, entry as entry_price, close as exit_price, q as quantity, pnl, strength, (t - ent) / 3600 as hours, why as reason from trades),
eq as (select symbol, bar_ts, cash + d * (close - entry) * q + abs(d) * q * entry as equity, cash from f)"""


def signals(b):
    w = B.last(10)
    z = (F.col("close") - F.avg("close").over(w)) / F.nullif(F.stddev_samp("close").over(w), F.lit(0.0))
    d = b.select("symbol", "bar_ts", "close", z.alias("z")).where("z is not null")
    return d.select("symbol", "bar_ts", "close", *rounded(9, signal=-F.col("z") / (1 + F.abs("z")), confidence=1 / (1 + F.abs("z") / 2)))


@registered(FOLD + " select symbol, entry_time, exit_time, direction, round(entry_price, 6) as entry_price, round(exit_price, 6) as exit_price, round(quantity, 6) as quantity, round(pnl, 6) as pnl, round(strength, 6) as strength, round(hours, 6) as hours, reason from tr")
def strategy_trades(b):
    d = T.run(signals(b))
    return d.select("symbol", "entry_time", "exit_time", "direction", *r6(entry_price="entry_price", exit_price="exit_price", quantity="quantity", pnl="pnl", strength="strength", hours="hours"), "reason")


@registered(FOLD + f" select symbol, bar_ts, round(equity, 6) as equity, round(1 - equity / max(equity) over ({W}), 6) as drawdown, round(cash, 6) as cash, round(equity - cash, 6) as value from eq")
def strategy_equity(b):
    return T.run(signals(b), what="equity").select("symbol", "bar_ts", *r6(equity="equity", drawdown="drawdown", cash="cash", value="value"))


@registered(FOLD + ", k as (select pnl, unnest([{'kind': 'direction', 'label': case when direction > 0 then 'long' else 'short' end}, {'kind': 'strength', 'label': case when abs(strength) >= 0.7 then 'strong' when abs(strength) >= 0.3 then 'medium' else 'weak' end}, {'kind': 'reason', 'label': reason}, {'kind': 'held', 'label': case when hours < 4 then 'short' when hours < 24 then 'day' else 'long' end}]) as x from tr) select x.kind as kind, x.label as label, count(*) as n, round(sum(pnl), 4) as pnl from k group by 1, 2")
def trade_attribution(b):
    return T.attribution(T.run(signals(b))).select("kind", "label", "n", *rounded(4, pnl="pnl"))


@registered(FOLD + " select symbol, count(*) as n, count(*) filter (where pnl > 0) as wins, count(*) filter (where pnl < 0) as losses, round(count(*) filter (where pnl > 0) / count(*), 6) as win_rate, round(avg(pnl) filter (where pnl > 0), 6) as mean_win, round(avg(pnl) filter (where pnl < 0), 6) as mean_loss, round(max(pnl), 6) as best, round(min(pnl), 6) as worst, round(sum(pnl) filter (where pnl > 0) / nullif(-sum(pnl) filter (where pnl < 0), 0), 6) as profit_factor, round(avg(pnl), 6) as expectancy, round(case when count(*) > 1 then coalesce(nullif(corr(pnl, hours), 'nan'::double), 0) else 0 end, 5) as hours_corr, round(case when count(*) > 1 then coalesce(nullif(corr(pnl, abs(strength)), 'nan'::double), 0) else 0 end, 5) as strength_corr from tr group by symbol")
def trade_analysis(b):
    d = T.analysis(T.run(signals(b)), ("symbol",))
    return d.select("symbol", "n", "wins", "losses", *r6(win_rate="win_rate", mean_win="mean_win", mean_loss="mean_loss", best="best", worst="worst", profit_factor="profit_factor", expectancy="expectancy"), *rounded(5, hours_corr="hours_corr", strength_corr="strength_corr"))


@registered(FOLD + ", a as (select symbol, exit_time, sign(pnl) as s, case when sign(pnl) = lag(sign(pnl)) over (partition by symbol order by exit_time) then 0 else 1 end as turn from tr), r as (select symbol, s, sum(turn) over (partition by symbol order by exit_time) as run from a), l as (select symbol, s, run, count(*) as n from r group by all) select symbol, coalesce(max(n) filter (where s = 1), 0) as most_wins, coalesce(max(n) filter (where s = -1), 0) as most_losses from l group by symbol")
def trade_streaks(b):
    return T.streaks(T.run(signals(b)))


@registered(f", k as (select symbol, bar_ts, close as v, max(close) over ({W}) as peak from b), m as (select *, case when v = peak and peak > coalesce(lag(peak) over ({W}), -1) then 1 else 0 end as new from k), p as (select *, sum(new) over ({W}) as period from m), r as (select symbol, period, min(bar_ts) filter (where v < peak) as start_time, max(bar_ts) as last_ts, min(bar_ts) as first_ts, count(*) filter (where v < peak) as bars, max((peak - v) / peak) as depth from p group by all), n as (select *, lead(first_ts) over (partition by symbol order by period) as next_ts from r) select symbol, start_time, coalesce(next_ts, last_ts) as end_time, date_diff('second', start_time, coalesce(next_ts, last_ts)) as seconds, bars, round(depth, 6) as depth, next_ts is not null as recovered from n where start_time is not null")
def drawdown_periods(b):
    return T.drawdown_periods(b, "close").withColumn("depth", r6(x="depth")[0])


@registered(f", k as (select symbol, bar_ts, close as v, close / nullif(lag(close) over ({W}), 0) - 1 as r, close / max(close) over ({W}) - 1 as dd from b), q as (select symbol, quantile_cont(r, 0.05) as var_95 from k group by symbol), a as (select symbol, any_value(var_95) as var_95, count(*) as n, arg_max(v, bar_ts) / arg_min(v, bar_ts) - 1 as total_return, date_diff('day', min(bar_ts), max(bar_ts)) as days, stddev_samp(r) as s, stddev_pop(r) as p, avg(r) as m, stddev_samp(r) filter (where r < 0) as down, min(dd) as max_drawdown, avg(r) filter (where r <= var_95) as cvar_95 from k join q using (symbol) group by symbol), c as (select *, case when days > 0 and total_return > -1 then ln(1 + total_return) * 365.25 / days end as annual from a) select symbol, n, round(total_return, 6) as total_return, round(annual, 6) as annual_log, round(s * sqrt(252), 5) as volatility, round((m * 252 - 0.02) / nullif(s * sqrt(252), 0), 6) as sharpe, round((m * 252 - 0.02) / nullif(p * sqrt(252), 0), 6) as population_sharpe, round((m * 252 - 0.02) / nullif(down * sqrt(252), 0), 6) as sortino, round(case when annual < 5 then (exp(annual) - 1) / nullif(abs(max_drawdown), 0) end, 6) as calmar, round(max_drawdown, 6) as max_drawdown, round(var_95, 6) as var_95, round(cvar_95, 6) as cvar_95 from c")
def performance(b):
    """The annual return of a month's prices may be vast, so its logarithm is told, and Calmar's ratio where it isn't."""
    d = T.performance(b, "close")
    return d.select("symbol", "n", *r6(total_return="total_return", annual_log="annual_log", sharpe="sharpe", population_sharpe="population_sharpe", sortino="sortino", calmar="case when annual_log < 5 then calmar end", max_drawdown="max_drawdown", var_95="var_95", cvar_95="cvar_95"), *rounded(5, volatility="volatility"))


TRIPS = costs.ORDERS + f""", j as (select symbol, bar_ts, case side when 'BUY' then quantity else -quantity end as x, price, row_number() over ({W}, side) as i from o),
s as (select symbol, 0::bigint as i, 0.0::double as held, 0.0::double as mean, null::timestamp as since, 0.0::double as n, 0 as sign, 0.0::double as entry, null::timestamp as entered from (select distinct symbol from j)
union all select symbol, i, k + rest, case when rest <> 0 then (abs(k) * mean + abs(rest) * price) / (abs(k) + abs(rest)) else mean end, case when rest <> 0 and k = 0 then bar_ts else since end, n, sign, mean, since from (
 select *, held - sign * n as k, x + sign * n as rest from (
  select s.symbol, j.i, j.bar_ts, j.x, j.price, s.held, s.mean, s.since, case when s.held * j.x < 0 then least(abs(j.x), abs(s.held)) else 0 end as n, sign(s.held)::int as sign from s join j on s.symbol = j.symbol and j.i = s.i + 1)))"""


@registered(TRIPS + " select s.symbol, entered as entry_time, j.bar_ts as exit_time, sign as direction, round(n, 6) as quantity, round(entry, 6) as entry_price, round(price, 6) as exit_price, round(sign * (price - entry) * n, 6) as pnl from s join j on s.symbol = j.symbol and s.i = j.i where n > 0")
def round_trips(b):
    return T.round_trips(costs.orders(b)).select("symbol", "entry_time", "exit_time", "direction", *r6(quantity="quantity", entry_price="entry_price", exit_price="exit_price", pnl="pnl"))
