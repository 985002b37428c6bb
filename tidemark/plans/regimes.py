"""Queries of regimes, which are here the terciles of a close in its range of the last ten bars; returns are squashed to -1 .. 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import regimes as R
from tidemark.plans.registry import W, r6, registered, rounded

_w = f"({W} rows between 9 preceding and current row)"
ROWS = f", g as (select *, (close - min(close) over {_w}) / nullif(max(close) over {_w} - min(close) over {_w}, 0) as pos, close / nullif(lag(close) over ({W}), 0) - 1 as raw, row_number() over ({W}) as i from b), q as (select symbol, bar_ts, close, volume, i, raw / (1 + abs(raw)) as r, case when pos < 1 / 3.0::double then 'low' when pos < 2 / 3.0::double then 'middle' else 'high' end as regime from g where pos is not null and raw is not null)"
RUNS = ROWS + f", c as (select *, case when regime = lag(regime) over ({W}) then 0 else 1 end as turn from q), j as (select *, sum(turn) over ({W}) as run from c), s as (select symbol, run, regime, min(bar_ts) as first_ts, max(bar_ts) as last_ts, count(*) as n, avg(close) as mean, stddev_pop(close) as std from j group by all)"


def rows(b):
    w = B.last(10)
    low, high = F.min("close").over(w), F.max("close").over(w)
    d = b.select("symbol", "bar_ts", "close", "volume", ((F.col("close") - low) / F.nullif(high - low, F.lit(0.0))).alias("pos"), (F.col("close") / F.nullif(B.back("close"), F.lit(0.0)) - 1).alias("raw"), F.row_number().over(B.by_symbol()).alias("i"))
    d = d.where("pos is not null and raw is not null")
    return d.select("symbol", "bar_ts", "close", "volume", "i", (F.col("raw") / (1 + F.abs("raw"))).alias("r"), F.when(F.col("pos") < 1 / 3, "low").when(F.col("pos") < 2 / 3, "middle").otherwise("high").alias("regime"))


@registered(RUNS + " select symbol, run, regime, first_ts, last_ts, n, round(mean, 6) as mean, round(std, 6) as std from s")
def regime_segments(b):
    return R.runs(rows(b)).select("symbol", "run", "regime", "first_ts", "last_ts", "n", *r6(mean="mean", std="std"))


@registered(RUNS + " select symbol, regime, count(*) as n_runs, round(avg(n), 6) as mean_length, max(n) as longest, min(n) as shortest, round(avg((n >= 5)::int), 6) as stable_share from s group by all")
def state_persistence(b):
    return R.persistence(R.runs(rows(b))).select("symbol", "regime", "n_runs", *r6(mean_length="mean_length"), "longest", "shortest", *r6(stable_share="stable_share"))


@registered(RUNS + ", n as (select symbol, regime, lead(regime) over (partition by symbol order by run) as next_state from s), k as (select symbol, regime, next_state, count(*) as n from n where next_state is not null group by all) select symbol, regime, next_state, n, round(n / sum(n) over (partition by symbol, regime), 6) as share from k")
def state_transitions(b):
    return R.transitions(R.runs(rows(b))).select("symbol", "regime", "next_state", "n", *r6(share="share"))


CHARACTER = ROWS + ", l as (select *, lag(r) over (partition by symbol, regime order by bar_ts) as last_r, avg(r) over (partition by symbol, regime) as m from q), a as (select symbol, regime, count(*) as n, avg(r) as mean, stddev_pop(r) as std, avg((r - m) ** 3) as m3, avg((r - m) ** 4) as m4, covar_pop(r, last_r) as cv, stddev_pop(r) filter (where last_r is not null) * stddev_pop(last_r) as sd from l group by all), h as (select *, coalesce(m3 / nullif(std, 0) ** 3, 0) as skew, coalesce(m4 / nullif(std, 0) ** 4 - 3, 0) as kurtosis, coalesce(abs(cv / nullif(sd, 0)), 0) as trend, n / sum(n) over (partition by symbol) as share from a)"


@registered(CHARACTER + " select symbol, regime, n, round(share, 6) as share, round(mean, 6) as mean, round(std, 6) as std, round(skew, 5) + 0 as skew, round(kurtosis, 5) as kurtosis, round(trend, 5) as trend, case when std > 0.5 then 'high volatility' when trend > 0.6 then 'trending' when 1 - trend > 0.6 then 'mean reverting' else 'mixed' end as kind, case when mean > 0.3 then 'bull' when mean < -0.3 then 'bear' else 'sideways' end as condition, case when std > 0.7 then 'high' when std > 0.3 then 'medium' else 'low' end as risk from h")
def regime_characteristics(b):
    d = R.characteristics(rows(b))
    kinds = [R.regime_type(F.col("std"), F.col("trend"), 1 - F.col("trend")).alias("kind"), R.market_condition(F.col("mean")).alias("condition"), R.risk_level(F.col("std")).alias("risk")]
    return d.select("symbol", "regime", "n", *r6(share="share", mean="mean", std="std"), *rounded(5, skew="skew", kurtosis="kurtosis", trend="trend"), *kinds)


@registered(f", n as (select symbol, bar_ts, ln(1 + close) as x, count(*) over (partition by symbol) as n, row_number() over ({W}) as i from b), d as (select a.symbol, a.n, a.i - c.i as k, stddev_pop(a.x - c.x) as s from n a join n c on a.symbol = c.symbol and a.i - c.i between 2 and 20 group by all), h as (select symbol, regr_slope(ln(s), ln(k)) as hurst from d where k <= n // 2 and s > 0 group by symbol) select symbol, round(hurst, 6) as hurst, round(least(greatest(1 - 2 * hurst, 0), 1), 6) as reversion from h")
def hurst_scores(b):
    return R.hurst(b.select("symbol", "bar_ts", F.log1p("close").alias("x"))).select("symbol", *r6(hurst="hurst", reversion="reversion"))


@registered(ROWS + f", y as (select symbol, regime, count(*) as n, avg(r) as m, var_pop(r) as v from q group by all), p as (select *, n / sum(n) over (partition by symbol) as p from y), t as (select symbol, count(*) as n_states, var_pop(m) as between_v, avg(v) as within, sum(-p * ln(p)) as h from p group by symbol), k as (select symbol, (regime <> lag(regime) over ({W}))::int as c from q), z as (select symbol, sum(c) as changes, count(*) as n from k group by symbol) select symbol, n_states, round(between_v, 6) as between, round(within, 6) as within, round(coalesce(between_v / nullif(between_v + within, 0), 0), 6) as separability, round(case when n_states > 1 then 1 - h / ln(n_states) else 1 end, 6) as consistency, round(1 - least(1, 2 * changes / n), 6) as stability from t join z using (symbol)")
def regime_validation(b):
    return R.separability(rows(b)).select("symbol", "n_states", *r6(between="between", within="within", separability="separability", consistency="consistency", stability="stability"))


_names = ("close", "volume", "r")


@registered(ROWS + ", v as (" + " union all ".join(f"select symbol, regime, '{c}' as name, {c}::double as v from q" for c in _names) + "), a as (select symbol, regime, name, 0.5 * coalesce(stddev_pop(v) / nullif(abs(avg(v)), 0), 0) + 0.5 * abs(avg(v)) as raw from v group by all), i as (select symbol, regime, name, coalesce(raw / nullif(sum(raw) over (partition by symbol, regime), 0), 0) as importance from a) select symbol, regime, name, round(importance, 6) as importance, row_number() over (partition by symbol, regime order by importance desc, name) as place from i")
def state_importance(b):
    return R.state_importance(rows(b), _names).select("symbol", "regime", "name", *r6(importance="importance"), "place")


EQUITY = ROWS + f", k as (select symbol, bar_ts, regime from q where i % 3 = 0), u as (select b.symbol, b.bar_ts, b.close as equity, k.regime as own from b left join k using (symbol, bar_ts)), f as (select symbol, bar_ts, equity, coalesce(last_value(own ignore nulls) over ({W} rows between unbounded preceding and current row), first_value(own ignore nulls) over ({W} rows between current row and unbounded following)) as regime from u), o as (select *, equity / nullif(lag(equity) over (partition by symbol, regime order by bar_ts), 0) - 1 as rr from f), e as (select symbol, regime, count(*) as n, arg_max(equity, bar_ts) / arg_min(equity, bar_ts) - 1 as total_return, stddev_samp(rr) as s, avg(rr) as m from o group by all), p as (select *, n / sum(n) over (partition by symbol) as share from e)"


def by_regime(b):
    known = rows(b).where("i % 3 = 0")
    return R.performance_by(R.filled_regimes(b.select("symbol", "bar_ts", F.col("close").alias("equity")), known))


@registered(EQUITY + " select symbol, regime, n, round(share, 6) as share, round(total_return, 6) as total_return, round(s * sqrt(105120), 3) as volatility, round(coalesce(m / nullif(s, 0) * sqrt(105120), 0), 4) as sharpe from p")
def regime_performance(b):
    return by_regime(b).select("symbol", "regime", "n", *r6(share="share", total_return="total_return"), *rounded(3, volatility="volatility"), *rounded(4, sharpe="sharpe"))


@registered(EQUITY + " select symbol, arg_max(regime, row(total_return, regime)) as best, arg_min(regime, row(total_return, regime)) as worst, round(sum(total_return * share), 6) as mean_return from p group by symbol")
def regime_summary(b):
    return R.summary(by_regime(b)).select("symbol", "best", "worst", *r6(mean_return="mean_return"))


@registered(RUNS + ", x as (select symbol, i from c where turn = 1), e as (select symbol, 'peak' as event, arg_max(i, row(close, -i)) as at_i from q group by symbol union all select symbol, 'trough', arg_min(i, row(close, i)) from q group by symbol) select x.symbol, x.i, e.event, e.at_i as \"at\" from x join e on x.symbol = e.symbol and abs(x.i - e.at_i) <= 5")
def event_matches(b):
    """Changes of regime near a symbol's highest and lowest close."""
    d = rows(b)
    changes = d.withColumn("last", B.back("regime")).where("last is null or regime <> last").select("symbol", "i")
    top = d.groupBy("symbol").agg(F.max_by("i", F.struct("close", -F.col("i"))).alias("peak"), F.min_by("i", F.struct("close", "i")).alias("trough"))
    events = top.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("event"), F.col(n).alias("at")) for n in ("peak", "trough")])).alias("x")).select("symbol", "x.*")
    return R.near_events(changes, events)


@registered(f", m as (select bar_ts, avg(close) as w from b group by 1), d as (select symbol, bar_ts, close / nullif(lag(close) over ({W}), 0) - 1 as a, w / nullif(lag(w) over ({W}), 0) - 1 as m from b join m using (bar_ts)), k as (select symbol, count(*) as n, covar_pop(a, m) / nullif(var_pop(m), 0) as beta, avg(a) as ma, avg(m) as mm, covar_pop(a, m) / nullif(stddev_pop(a) * stddev_pop(m), 0) as corr, stddev_samp(a - m) as te from d where a is not null and m is not null group by symbol) select symbol, n, round(beta, 5) as beta, round((ma - beta * mm) * 252, 3) as alpha, round(corr, 6) as corr, round(te * sqrt(252), 4) as tracking_error, round((ma - mm) / nullif(te, 0) * sqrt(252), 5) as information_ratio from k")
def benchmark(b):
    """Each symbol against a table of the mean close of a time."""
    d = R.against(b.select("symbol", "bar_ts", F.col("close").alias("v")), b.groupBy("bar_ts").agg(F.avg("close").alias("w")))
    return d.select("symbol", "n", *rounded(5, beta="beta", information_ratio="information_ratio"), *rounded(3, alpha="alpha"), *r6(corr="corr"), *rounded(4, tracking_error="tracking_error"))
