"""The registered queries of the market operators, each beside its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hmm, joins, signals, voting
from tidemark.operators import bars as B
from tidemark.operators.recurrences import recurrent
from tidemark.plans.registry import BASES, QUERIES, SQL, W, r6
from tidemark.plans.registry import registered as by_hour
from tidemark.sources import market

HOUR = BASES["hour"]


def registered(sql: str):
    return by_hour(sql, "hour")


F20 = f"({W} rows between 19 preceding and current row)"


@registered(" select * from b")
def bars_hourly(b):
    return b


@registered(f", f as (select *, avg(close) over w as sma, stddev_samp(close) over w as sd, lead(close, 4) over ({W}) as nx from b window w as {F20}) select symbol, bar_ts, close, round(sma, 6) as sma, round((close - sma) / nullif(sd, 0), 6) as z, round(-((close - sma) / nullif(sd, 0)) / greatest(sd, 1e-8), 6) as s_mr, cast(sign(nx - close) as int) as label from f")
def market_slice(b):
    """The flagship: average, z-score, mean-reversion signal and direction label of hourly bars."""
    return b.select("symbol", "bar_ts", "close", *r6(sma=B.sma(), z=B.zscore(), s_mr=B.mean_reversion()), B.direction().alias("label"))


@registered(f", p as (select *, lag(close) over o as prev, lag(close, 5) over o as p5, lag(close, 2) over o as p2 from b window o as ({W})) select symbol, bar_ts, round(case when prev is null or prev = 0 then 0 else close / prev - 1 end, 6) as momentum, round(close / p5 - 1, 6) as roc_5, round(p2, 6) as lag_2, round(greatest(high - low, abs(high - prev), abs(low - prev)), 6) as tr, round(ln(close / prev), 6) as log_return, round(case when count(close) over t >= 10 then max(close) over t - min(close) over t end, 6) as range_10 from p window t as ({W} rows between 9 preceding and current row)")
def returns_and_ranges(b):
    spread = F.max("close").over(B.last(10)) - F.min("close").over(B.last(10))
    return b.select("symbol", "bar_ts", *r6(momentum=B.momentum(), roc_5=F.col("close") / B.back("close", 5) - 1, lag_2=B.back("close", 2), tr=B.true_range(), log_return=F.log(F.col("close") / B.back("close")), range_10=B.when_full(spread, 10)))


@registered(f", t as (select *, (high + low + close) / 3 as tp from b), m as (select *, avg(tp) over {F20} as mean from t), d as (select *, avg(abs(tp - mean)) over {F20} as dev, count(*) over {F20} as n from m) select symbol, bar_ts, round(case when n >= 10 and dev * 0.015 > 1e-10 then (tp - mean) / (0.015 * dev) end, 6) as cci from d")
def cci(b):
    return B.cci(b).select("symbol", "bar_ts", *r6(cci=F.col("cci")))


def _ew(alpha: str, c: str) -> str:
    return f"list_reduce(list({c}) over ({W} rows between unbounded preceding and current row), lambda a, v: (1 - {alpha}) * a + {alpha} * v)"


@registered(f", m as (select *, close - lag(close) over ({W}) as d from b), g as (select *, coalesce(greatest(d, 0), 0) as up, coalesce(greatest(-d, 0), 0) as down from m), e as (select symbol, bar_ts, {_ew('(2 / 21.0::double)', 'close')} as ema, {_ew('(1 / 14.0::double)', 'up')} as u, {_ew('(1 / 14.0::double)', 'down')} as w from g) select symbol, bar_ts, round(ema, 6) as ema, round(case when w <= 1e-10 then 100 else 100 - 100 / (1 + u / w) end, 6) as rsi from e")
def ema_rsi(b):
    return recurrent(b).select("symbol", "bar_ts", *r6(ema=F.col("ema"), rsi=F.col("rsi")))


@registered(f", l as (select symbol, (lead(close, 12) over ({W}) - close) / nullif(close, 0) as ret from b), c as (select symbol, case when ret > 0.02 then 'Buy' when ret < -0.02 then 'Sell' when ret is not null then 'Hold' end as label from l) select symbol, label, count(*) as n from c group by 1, 2")
def label_distribution(b):
    return b.select("symbol", B.label_of(B.future_return(12)).alias("label")).groupBy("symbol", "label").agg(F.count("*").alias("n"))


@registered(f", g as (select symbol, close, date_diff('second', lag(bar_ts) over ({W}), bar_ts) as gap from b) select symbol, count(*) as n, count(*) filter (where close is null) as n_null, count(*) filter (where gap = 0) as n_duplicate, count(*) filter (where gap > 3 * 3600) as n_gap, max(gap) as longest from g group by symbol")
def quality_report(b):
    gap = (F.unix_timestamp("bar_ts") - F.unix_timestamp(B.back("bar_ts"))).alias("gap")
    return b.select("symbol", "close", gap).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("close").isNull()).alias("n_null"), F.count_if(F.col("gap") == 0).alias("n_duplicate"), F.count_if(F.col("gap") > 3 * 3600).alias("n_gap"), F.max("gap").alias("longest"))


@registered(f", d as (select *, max(close) over ({W}) as peak, close / lag(close) over ({W}) - 1 as r from b) select symbol, round(min((close - peak) / peak), 6) as max_drawdown, round(stddev_samp(r), 6) as vol, round(avg(r) / stddev_samp(r), 6) as sharpe, round(quantile_cont(r, 0.05), 6) as var_95, round(avg(r) filter (where r < 0), 6) as mean_loss from d group by symbol")
def risk_metrics(b):
    d = B.drawdowns(b).withColumn("r", F.col("close") / B.back("close") - 1)
    return d.groupBy("symbol").agg(*r6(max_drawdown=F.min("drawdown"), vol=F.stddev_samp("r"), sharpe=F.avg("r") / F.stddev_samp("r"), var_95=F.percentile("r", 0.05), mean_loss=F.avg(F.when(F.col("r") < 0, F.col("r")))))


@registered(f", i as (select *, row_number() over ({W})::double as i, close / lag(close) over ({W}) - 1 as r from b), s as (select symbol, bar_ts, i, regr_slope(close, i) over w / avg(close) over w as slope, stddev_pop(r) over ({W} rows between 18 preceding and current row) as vol from i window w as {F20}), g as (select symbol, bar_ts, case when i < 20 then null when vol > 0.02 then 'Volatile' when abs(slope) > 0.001 then 'Trending' else 'Ranging' end as regime from s), t as (select symbol, regime, lag(regime) over ({W}) as prev from g) select symbol, prev, regime, count(*) as n from t where regime is not null and prev is not null group by all")
def regime_transitions(b):
    d = B.regimes(b).select("symbol", "bar_ts", "regime", B.back("regime").alias("prev"))
    return d.where("regime is not null and prev is not null").groupBy("symbol", "prev", "regime").agg(F.count("*").alias("n"))


def _kernel_sql(weights: list[float]) -> str:
    lags = [f"lag(close, {i}) over o" for i in range(len(weights))]
    return f"({' + '.join(f'coalesce({v} * {x!r}::double, 0)' for v, x in zip(lags, weights))}) / ({' + '.join(f'(case when {v} is null then 0 else {x!r}::double end)' for v, x in zip(lags, weights))})"


@registered(f" select symbol, bar_ts, round({_kernel_sql(B.rational_quadratic())}, 6) as rational, round({_kernel_sql(B.gaussian())}, 6) as gauss from b window o as ({W})")
def kernels(b):
    return b.select("symbol", "bar_ts", *r6(rational=B.kernel(B.rational_quadratic()), gauss=B.kernel(B.gaussian())))


VOTE = """, f as (select *, close / lag(close) over o - 1 as f1, (close - avg(close) over w) / nullif(stddev_samp(close) over w, 0) as f2, close / lag(close, 5) over o - 1 as f3, cast(sign(lead(close, 4) over o - close) as int) as label, row_number() over o - 1 as i from b window o as (partition by symbol order by bar_ts), w as (partition by symbol order by bar_ts rows between 19 preceding and current row)),
p as (select q.symbol, q.bar_ts, c.i as j, c.label, round(ln(1 + abs(q.f1 - c.f1)) + ln(1 + abs(q.f2 - c.f2)) + ln(1 + abs(q.f3 - c.f3)), 9) as d from f q join f c on q.symbol = c.symbol and c.i <= q.i - 4 and c.i >= q.i - 2000 where c.i % 4 = 0 and c.label is not null and q.f1 + q.f2 + q.f3 is not null and c.f1 + c.f2 + c.f3 is not null),
r as (select *, row_number() over (partition by symbol, bar_ts order by d, j) as n from p)
select symbol, bar_ts, sum(label)::bigint as vote, count(*) as n, round(max(d), 6) as radius from r where n <= 8 group by 1, 2"""


@registered(VOTE)
def neighbour_vote(b):
    d = b.withColumns({"f1": F.col("close") / B.back("close") - 1, "f2": B.zscore(), "f3": F.col("close") / B.back("close", 5) - 1, "label": B.direction()})
    return voting.vote(d, ["f1", "f2", "f3"]).withColumn("radius", F.round("radius", 6))


def _signals(b):
    d = b.select("symbol", "bar_ts", "close", signals.squash(B.mean_reversion()).alias("s_mr"), signals.squash(B.momentum()).alias("s_tsmom"))
    return d.withColumn("score", F.round(signals.score({"s_mr": 0.6, "s_tsmom": 0.4}), 6)).withColumn("side", signals.side(F.col("score"), 0.05))


FUSED = f", f as (select symbol, bar_ts, close, -((close - avg(close) over w) / nullif(stddev_samp(close) over w, 0)) / greatest(stddev_samp(close) over w, 1e-8) as m, case when lag(close) over o is null or lag(close) over o = 0 then 0 else close / lag(close) over o - 1 end as t from b window o as ({W}), w as {F20}), s as (select *, round(m / (1 + abs(m)) * 0.6::double + t / (1 + abs(t)) * 0.4::double, 6) as score from f), g as (select *, case when score > 0.05 then 'BUY' when score < -0.05 then 'SELL' else 'HOLD' end as side from s)"


@registered(f"{FUSED} select symbol, bar_ts, score, side from g")
def fused_signals(b):
    return _signals(b).select("symbol", "bar_ts", "score", "side")


@registered(f"{FUSED}, l as (select side, cast(sign(lead(close, 4) over ({W}) - close) as int) as label from g) select side, label, count(*) as n from l where label is not null group by 1, 2")
def confusion(b):
    d = _signals(b).select("side", B.direction().alias("label"))
    return d.where("label is not null").groupBy("side", "label").agg(F.count("*").alias("n"))


@registered("")
def hidden_states(b):
    d = b.select("symbol", "bar_ts", F.log(F.col("close") / B.back("close")).alias("r"))
    return hmm.infer(d, hmm.fit(d, ["r"])[0], ["r"])


del SQL["hidden_states"]  # an iteration: no SQL


@registered(" , d as (select symbol, date_trunc('day', bar_ts) + interval 1 day as bar_ts, arg_max(close, bar_ts) as day_close from b group by symbol, date_trunc('day', bar_ts)) select b.symbol, b.bar_ts, b.close, d.day_close from b asof left join d on b.symbol = d.symbol and b.bar_ts >= d.bar_ts")
def last_day_close(b):
    """Each bar with the close of the last day that was over."""
    days = b.groupBy("symbol", F.date_trunc("day", "bar_ts").alias("day")).agg(F.max_by("close", "bar_ts").alias("day_close"))
    return joins.as_of(b.select("symbol", "bar_ts", "close"), days.select("symbol", (F.col("day") + F.expr("interval 1 day")).alias("bar_ts"), "day_close"), "day_close")


@registered(f", r as (select symbol, bar_ts, close / lag(close) over ({W}) - 1 as r from b), m as (select bar_ts, avg(r) as m from r where r is not null group by 1) select symbol, round(regr_slope(r, m), 6) as beta, round(regr_intercept(r, m), 6) as alpha, round(corr(r, m), 6) as corr, count(r) as n from r join m using (bar_ts) group by symbol")
def market_beta(b):
    d = joins.against_market(b.select("symbol", "bar_ts", (F.col("close") / B.back("close") - 1).alias("r")))
    return d.select("symbol", *r6(beta=F.col("beta"), alpha=F.col("alpha"), corr=F.col("corr")), "n")


RUNS = SQL["regime_transitions"].split(", t as (")[0]
SQL_RUNS = f"{RUNS}, c as (select *, case when regime is distinct from lag(regime) over ({W}) then 1 else 0 end as turn from g where regime is not null), j as (select *, sum(turn) over ({W}) as run from c), l as (select symbol, regime, run, count(*) as n from j group by all) select symbol, regime, count(*) as n_runs, max(n) as longest, round(avg(n), 6) as mean_length from l group by 1, 2"


@registered(SQL_RUNS.split(f"with recursive {HOUR}")[1])
def regime_runs(b):
    d = B.regimes(b).where("regime is not null").select("symbol", "bar_ts", "regime")
    turn = F.when(F.col("regime").eqNullSafe(B.back("regime")), 0).otherwise(1)
    runs = d.withColumn("turn", turn).withColumn("run", F.sum("turn").over(B.by_symbol())).groupBy("symbol", "regime", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("symbol", "regime").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean_length"))


RULES = {"price": "least(open, high, low, close) > 0", "range": "high >= low", "bracket": "high >= greatest(open, close) and low <= least(open, close)", "volume": "volume >= 0", "level": "(open + high + low + close) / 4 between 1e-4 and 1e6"}
BROKEN = ", ".join(f"case when not coalesce({x}, false) then '{n}' end" for n, x in RULES.items())


@registered(f", f as (select symbol, list_filter([{BROKEN}], lambda x: x is not null) as broken from b), u as (select symbol, unnest(case when len(broken) = 0 then [null] else broken end) as rule from f) select symbol, rule, count(*) as n from u group by 1, 2")
def broken_rules(b):
    """Bars by the rule they break; the null rule counts sound bars."""
    return b.select("symbol", F.explode_outer(market.faults()).alias("rule")).groupBy("symbol", "rule").agg(F.count("*").alias("n"))

from tidemark.plans import quality as _quality  # noqa: E402, F401  (registers its queries)
from tidemark.plans import features as _features  # noqa: E402, F401
from tidemark.plans import statistics as _statistics  # noqa: E402, F401
from tidemark.plans import costs as _costs  # noqa: E402, F401
from tidemark.plans import trades as _trades  # noqa: E402, F401
from tidemark.plans import regimes as _regimes  # noqa: E402, F401
from tidemark.plans import fusion as _fusion  # noqa: E402, F401
from tidemark.plans import research as _research  # noqa: E402, F401
from tidemark.plans import search as _search  # noqa: E402, F401
from tidemark.plans import sources as _sources  # noqa: E402, F401
