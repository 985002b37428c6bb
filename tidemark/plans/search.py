"""Queries of neighbour search, of folds with given parameters, and of the backtest of one symbol."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import backtest, hmm, search, signals
from tidemark.operators import bars as B
from tidemark.plans.registry import W, r6, registered, rounded

FEATURES = f", f as (select *, close / nullif(lag(close) over o, 0) - 1 as f1, (close - avg(close) over w) / nullif(stddev_samp(close) over w, 0) as f2, close / nullif(lag(close, 5) over o, 0) - 1 as f3, cast(sign(lead(close, 4) over o - close) as int) as label, row_number() over o - 1 as i from b window o as ({W}), w as ({W} rows between 19 preceding and current row))"
PAIRS = FEATURES + ", p as (select q.symbol, q.bar_ts, c.i as j, c.label, round(ln(1 + abs(q.f1 - c.f1)) + ln(1 + abs(q.f2 - c.f2)) + ln(1 + abs(q.f3 - c.f3)), 9) as d from f q join f c on q.symbol = c.symbol and c.i <= q.i - 4 and c.i >= q.i - 2000 where c.i % 4 = 0 and c.label is not null and q.f1 + q.f2 + q.f3 is not null and c.f1 + c.f2 + c.f3 is not null)"


def featured(b):
    move = lambda n: F.col("close") / F.nullif(B.back("close", n), F.lit(0.0)) - 1
    return b.withColumns({"f1": move(1), "f2": B.zscore(), "f3": move(5), "label": B.direction()})


def told(d):
    return d.select("symbol", "bar_ts", "vote", "n", "direction", *rounded(5, confidence="confidence", weighed="weighed", nearness="nearness"))


_vote = "sum(label)::int as vote, count(*)::int as n, sign(sum(label))::int as direction, round(1 / (1 + stddev_pop(d)), 5) as confidence, round(sum(label / (1 + d)) / sum(1 / (1 + d)), 5) + 0 as weighed, round(1 / (1 + avg(d)), 5) as nearness"


@registered(PAIRS + f", r as (select *, row_number() over (partition by symbol, bar_ts order by d, j) as o from p) select symbol, bar_ts, {_vote} from r where o <= 8 group by 1, 2")
def nearest_votes(b):
    return told(search.predict(featured(b), ["f1", "f2", "f3"]))


#: The scan as a fold over a query's samples: the bound, and the list of what is held, oldest first.
SCAN = """, t as (select *, row_number() over (partition by symbol, bar_ts order by j) - 1 as o from p), u as (select symbol, bar_ts, d, label, o // 4 as s from t where o % 4 = 0),
n as (select symbol, bar_ts, -1 as s, -1.0::double as bound, []::struct(d double, l int)[] as held from (select distinct symbol, bar_ts from u)
union all select symbol, bar_ts, s, case when not take then bound when len(more) > 3 and len(more) < grown then more[least({k} * 3 // 4, len(more) - 1) + 1].d else d end, case when take then more else held end from (
 select *, case when grown > {k} then with_new[2:] else with_new end as more from (
  select n.symbol, n.bar_ts, u.s, n.bound, n.held, u.d, u.d >= n.bound as take, list_append(n.held, {{'d': u.d, 'l': u.label}}) as with_new, len(n.held) + 1 as grown from n join u on n.symbol = u.symbol and n.bar_ts = u.bar_ts and u.s = n.s + 1))),
z as (select symbol, bar_ts, arg_max(held, s) as held from n group by all), y as (select symbol, bar_ts, unnest(held) as x from z), e as (select symbol, bar_ts, x.d as d, x.l as label from y)"""


@registered(PAIRS + SCAN.format(k=3) + f" select symbol, bar_ts, {_vote} from e group by 1, 2")
def scanned_votes(b):
    """The ordered scan with its running bound, three neighbours."""
    return told(search.predict(featured(b), ["f1", "f2", "f3"], mode="scan", k=3))


@registered(PAIRS + f", t as (select *, row_number() over (partition by symbol, bar_ts order by j) - 1 as o, count(*) over (partition by symbol, bar_ts) as m from p), r as (select *, row_number() over (partition by symbol, bar_ts order by d, j) as z from t where o % 4 = 0 and m > 20) select symbol, bar_ts, {_vote} from r where z <= 8 group by 1, 2", "hour")
def thinned_votes(b):
    """The mode that goes by the number of samples, where there are many: the nearest of each fourth."""
    d = featured(b)
    many = search.predict(d, ["f1", "f2", "f3"], mode="auto", many=20)
    # bars with up to 20 samples are voted on by the scan; they aren't told here
    i = d.withColumn("i", F.row_number().over(B.by_symbol()) - 1).withColumn("fit", ((F.col("i") % 4 == 0) & F.col("label").isNotNull() & F.expr("f1 + f2 + f3 is not null")).cast("int"))
    seen = i.select("symbol", "bar_ts", F.sum("fit").over(B.by_symbol().rowsBetween(-2000, -4)).alias("m")).where("m > 20")
    return told(many.join(seen.select("symbol", "bar_ts"), ["symbol", "bar_ts"]))


_ms = "case when lag(close) over o is null or lag(close) over o = 0 then 0 else close / lag(close) over o - 1 end"
FUSED = f", f as (select symbol, bar_ts, close, -((close - avg(close) over w) / nullif(stddev_samp(close) over w, 0)) / greatest(stddev_samp(close) over w, 1e-8) as m, {_ms} as t from b window o as ({W}), w as ({W} rows between 19 preceding and current row)), s as (select *, round(m / (1 + abs(m)) * 0.6::double + t / (1 + abs(t)) * 0.4::double, 6) as score from f), g as (select *, case when score > 0.05 then 'BUY' when score < -0.05 then 'SELL' else 'HOLD' end as side, epoch(bar_ts) as e, row_number() over ({W}) as i from s)"


def fused(b):
    d = b.select("symbol", "bar_ts", "close", signals.squash(B.mean_reversion()).alias("s_mr"), signals.squash(B.momentum()).alias("s_tsmom"))
    return d.withColumn("score", F.round(signals.score({"s_mr": 0.6, "s_tsmom": 0.4}), 6)).withColumn("side", signals.side(F.col("score"), 0.05))


@registered(FUSED + ", c as (select symbol, 0::bigint as i, null::double as last, false as emit from (select distinct symbol from g) union all select c.symbol, g.i, case when g.side <> 'HOLD' and (c.last is null or g.e - c.last >= 21600) then g.e else c.last end, g.side <> 'HOLD' and (c.last is null or g.e - c.last >= 21600) from c join g on c.symbol = g.symbol and g.i = c.i + 1) select g.symbol, g.bar_ts, g.side, c.emit from c join g using (symbol, i)", "hour")
def cooled_signals(b):
    return signals.cooled(fused(b), 6 * 3600)


@registered(FUSED + """, a as (select symbol, 0::bigint as i, 500000.0::double as cash, 0.0::double as held, 0.0::double as paid from (select distinct symbol from g)
union all select symbol, i, case when go then cash - (want - held) * close - fee else cash end, case when go then want else held end, case when go then paid + fee else paid end from (
 select *, greatest(1, abs(want - held) * close * 0.001) + abs(want - held) * close * 0.0005 as fee, side <> 'HOLD' and close > 0 and sign(want) <> sign(held) as go from (
  select a.symbol, g.i, g.close, g.side, a.cash, a.held, a.paid, (case g.side when 'BUY' then 1 else -1 end) * 0.05 * greatest(a.cash + a.held * g.close, 0) / g.close as want from a join g on a.symbol = g.symbol and g.i = a.i + 1)))
select symbol, bar_ts, round(a.cash, 4) as cash, round(a.held, 6) as position, round(a.cash + a.held * g.close, 4) as value, round(a.paid, 4) as cost from a join g using (symbol, i)""", "hour")
def backtest_snapshots(b):
    return backtest.run(fused(b)).select("symbol", "bar_ts", *rounded(4, cash="cash"), *r6(position="position"), *rounded(4, value="value", cost="cost"))


MODEL = hmm.Model(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[-0.3], [0.4]]), np.array([[0.2], [0.3]]))
_dens = [f"exp(-0.5 * (x - {m!r}::double) ** 2 / {v!r}::double) / sqrt({v!r}::double)" for m, v in ((-0.3, 0.2), (0.4, 0.3))]


@registered(f", r as (select symbol, bar_ts, close / nullif(lag(close) over ({W}), 0) - 1 as raw from b), x as (select symbol, bar_ts, raw / (1 + abs(raw)) as x, row_number() over ({W}) as i from r where raw is not null), d as (select *, {_dens[0]} as d0, {_dens[1]} as d1 from x), p as (select symbol, i, 0.6 * d0 / (0.6 * d0 + 0.4 * d1) as p0 from d where i = 1 union all select d.symbol, d.i, (p0 * 0.9::double + (1 - p0) * 0.2::double) * d0 / ((p0 * 0.9::double + (1 - p0) * 0.2::double) * d0 + (p0 * 0.1::double + (1 - p0) * 0.8::double) * d1) from p join d on p.symbol = d.symbol and d.i = p.i + 1) select symbol, bar_ts, round(p0, 6) as p0, round(1 - p0, 6) as p1, round(0.6 * d0 / (0.6 * d0 + 0.4 * d1), 6) as alone from p join d using (symbol, i)")
def filtered_states(b):
    """Probabilities of two states of a given model, filtered along a symbol's returns, and of the bar alone."""
    raw = F.col("close") / F.nullif(B.back("close"), F.lit(0.0)) - 1
    d = b.select("symbol", "bar_ts", raw.alias("raw")).where("raw is not null").select("symbol", "bar_ts", (F.col("raw") / (1 + F.abs("raw"))).alias("x"))
    got = hmm.infer(d, MODEL, ["x"]).join(d, ["symbol", "bar_ts"])
    own = [p * F.exp(-0.5 * F.pow(F.col("x") - m, 2) / v) / v**0.5 for p, m, v in ((0.6, -0.3, 0.2), (0.4, 0.4, 0.3))]
    return got.select("symbol", "bar_ts", *r6(p0=F.col("probs")[0], p1=F.col("probs")[1], alone=own[0] / (own[0] + own[1])))
