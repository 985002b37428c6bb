"""Queries of statistics. A prediction is the side of the last move, the outcome the sign of the move four bars ahead."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import bars as B
from tidemark.operators import quality, stationarity
from tidemark.operators import statistics as S
from tidemark.plans.registry import SQL, W, r6, registered, rounded

ROWS = f", g as (select symbol, bar_ts, close / nullif(lag(close) over ({W}), 0) - 1 as move, lead(close) over ({W}) / nullif(close, 0) - 1 as ahead, cast(sign(lead(close, 4) over ({W}) - close) as int) as actual from b), r as (select *, -move / (1 + abs(move)) as signal, case when -move / (1 + abs(move)) > 0.2 then 1 when -move / (1 + abs(move)) < -0.2 then -1 else 0 end as predicted from g where move is not null)"


def rows(b):
    d = b.select("symbol", "bar_ts", (F.col("close") / F.nullif(B.back("close"), F.lit(0.0)) - 1).alias("move"), (F.lead("close").over(B.by_symbol()) / F.nullif("close", F.lit(0.0)) - 1).alias("ahead"), B.direction().alias("actual"))
    d = d.where("move is not null").withColumn("signal", -F.col("move") / (1 + F.abs("move")))
    return d.withColumn("predicted", F.when(F.col("signal") > 0.2, 1).when(F.col("signal") < -0.2, -1).otherwise(0))


_sides = {"short": -1, "neutral": 0, "long": 1}
_cnt = ", ".join(f"count(*) filter (where predicted = {v} and actual = {v}) as tp_{s}, count(*) filter (where predicted = {v}) as p_{s}, count(*) filter (where actual = {v}) as a_{s}" for s, v in _sides.items())
_pr = ", ".join(f"coalesce(tp_{s} / nullif(p_{s}, 0), 0) as precision_{s}, coalesce(tp_{s} / nullif(a_{s}, 0), 0) as recall_{s}" for s in _sides)
_f1 = ", ".join(f"coalesce(2 * precision_{s} * recall_{s} / nullif(precision_{s} + recall_{s}, 0), 0) as f1_{s}" for s in _sides)
_measures = [f"{m}_{s}" for s in _sides for m in ("precision", "recall", "f1")] + ["precision", "recall", "f1", "accuracy", "hit_rate"]
_all = ", ".join(f"({' + '.join(f'{m}_{s} * p_{s}' for s in _sides)}) / n as {m}" for m in ("precision", "recall", "f1"))


@registered(ROWS + f", c as (select symbol, count(*) as n, {_cnt} from r where actual is not null group by symbol), d as (select *, {_pr} from c), e as (select *, {_f1} from d), h as (select *, {_all}, (tp_short + tp_neutral + tp_long) / n as accuracy, coalesce((tp_short + tp_long) / nullif(p_short + p_long, 0), 0) as hit_rate from e) select symbol, n, {', '.join(f'round({m}, 6) as {m}' for m in _measures)} from h")
def accuracy(b):
    return S.confusion(rows(b)).select("symbol", "n", *r6(**{m: m for m in _measures}))


@registered(ROWS + " select symbol, count(*) as n, round(coalesce(abs(avg(signal)) / nullif(stddev_samp(signal), 0), 0), 6) as noise_ratio, round(coalesce(corr(signal, ahead), 0), 6) as coefficient, round(avg(signal) filter (where signal > 0), 6) as mean_long, round(avg(signal) filter (where signal < 0), 6) as mean_short from r group by symbol")
def signal_quality(b):
    return S.signal_quality(rows(b)).select("symbol", "n", *r6(noise_ratio="noise_ratio", coefficient="coefficient", mean_long="mean_long", mean_short="mean_short"))


_pct = (25, 50, 75, 95, 99)


@registered(ROWS + f", l as (select symbol, list_sort(list(signal)) as x, stddev_pop(signal) as std, min(signal) as low, max(signal) as high from r group by symbol) select symbol, len(x) as n, round(std, 9) as std, round(low, 9) as low, round(high, 9) as high, {', '.join(f'round(x[cast(floor({p} / 100.0::double * (len(x) - 1)) as int) + 1], 9) + 0 as p{p}' for p in _pct)} from l")
def signal_distribution(b):
    d = rows(b)
    q = quality.floor_quantiles(d, {f"p{p}": F.floor(F.lit(p / 100) * (F.col("n") - 1)) for p in _pct}, "signal", ("symbol",))
    m = d.groupBy("symbol").agg(F.stddev_pop("signal").alias("std"), F.min("signal").alias("low"), F.max("signal").alias("high"))
    return q.join(m, "symbol").select("symbol", "n", *rounded(9, std="std", low="low", high="high", **{f"p{p}": f"p{p}" for p in _pct}))


_t = lambda x: f"(1 / (1 + {special.ERF_P}::double * abs({x})))"


def _erf(x: str) -> str:
    poly = " + ".join(f"{a}::double * {_t(x)} ** {k + 1}" for k, a in enumerate(special.ERF))
    return f"(sign({x}) * (1 - ({poly}) * exp(-({x}) * ({x}))))"


def _cdf(x: str) -> str:
    return f"((1 + {_erf(f'({x}) / sqrt(2)')}) / 2)"


_third = "(1 / 3.0::double)"
_p = f"case when n >= 30 then 2 * (1 - {_cdf(f'abs(k - n * {_third}) / sqrt(n * {_third} * (1 - {_third}))')}) when k > n * {_third} then 0.05 else 0.5 end"
_sign = f", q as (select symbol, count(*) as n, count(*) filter (where predicted = actual) as k, avg(signal) as m, coalesce(stddev_samp(signal), 0) as s, avg(signal * signal) as sq from r where actual is not null group by symbol), t as (select *, {_p} as p_accuracy, case when sq > 0.01 then 0.01 else 0.5 end as p_signal, k / n as p from q)"


@registered(ROWS + _sign + " select symbol, n, k as n_correct, round(p_accuracy, 6) as p_accuracy, round(p_signal, 6) as p_signal, round(greatest(p - 1.96 * sqrt(p * (1 - p) / n), 0), 6) as low, round(least(p + 1.96 * sqrt(p * (1 - p) / n), 1), 6) as high, round(m - 1.96 * s / sqrt(n), 6) as signal_low, round(m + 1.96 * s / sqrt(n), 6) as signal_high, case when n < 30 then 0.1 when n < 100 then 0.3 when n < 300 then 0.6 else 0.8 end as power, n >= 30 as enough from t")
def significance(b):
    d = S.significance(rows(b).where("actual is not null").withColumn("correct", F.col("predicted") == F.col("actual")))
    return d.select("symbol", "n", "n_correct", *r6(p_accuracy="p_accuracy", p_signal="p_signal", low="low", high="high", signal_low="signal_low", signal_high="signal_high"), F.col("power").cast("double").alias("power"), "enough")


@registered(ROWS + _sign + ", m as (select symbol as name, p_accuracy as p, row_number() over (order by p_accuracy, symbol) as rk, count(*) over () as m from t) select name, round(p, 6) as p, round(least(p * m, 1), 6) as bonferroni, round(least(min(p * m / rk) over (order by rk rows between current row and unbounded following), 1), 6) as q from m", "hour")
def corrected_tests(b):
    """The tests of all symbols corrected for their number, a row each."""
    d = S.significance(rows(b).where("actual is not null").withColumn("correct", F.col("predicted") == F.col("actual"))).select(F.col("symbol").alias("name"), F.col("p_accuracy").alias("p"))
    m = d.agg(F.count("*").alias("m"))
    return S.benjamini_hochberg(d.join(F.broadcast(m))).select("name", *r6(p="p", bonferroni=S.bonferroni(F.col("p"), F.col("m")), q="q"))


@registered(ROWS + f", o as (select *, least(floor((row_number() over ({W}) - 1) / greatest(floor(count(*) over (partition by symbol) / 3), 1)), 2)::int as third from r where actual is not null), q as (select symbol, third, count(*) as n, count(*) filter (where predicted = actual) as k from o group by all) select symbol, third, n, round({_p}, 6) as p, round(greatest(k / n - 1.96 * sqrt(k / n * (1 - k / n) / n), 0), 6) as low, round(least(k / n + 1.96 * sqrt(k / n * (1 - k / n) / n), 1), 6) as high from q")
def positional_tests(b):
    d = S.positional_thirds(rows(b).where("actual is not null")).withColumn("correct", F.col("predicted") == F.col("actual"))
    return S.significance(d, keys=("symbol", "third")).select("symbol", "third", "n", *r6(p="p_accuracy", low="low", high="high"))


@registered(", n as (select symbol, count(*) as n, stddev_samp(close) / avg(close) as effect from b group by symbol) select symbol, n, round(least(greatest(1 / (1 + exp(-(effect * sqrt(n) - 1.96))), 0.05), 0.99), 6) as power, cast(ceil((case when effect >= 0.8 then 64 when effect >= 0.5 then 176 when effect >= 0.2 then 1571 else 10000 end) * 0.9 / 0.8) as bigint) as required from n")
def sample_sizes(b):
    d = b.groupBy("symbol").agg(F.count("*").alias("n"), (F.stddev_samp("close") / F.avg("close")).alias("effect"))
    return d.select("symbol", "n", F.round(S.power_for_effect(F.col("n"), F.col("effect")), 6).alias("power"), S.required_size(F.col("effect"), F.lit(0.9)).alias("required"))


@registered(f", d as (select symbol, count(*) as n, avg(high - close) as x, avg((high - close) - (close - low)) as mean_diff, stddev_samp((high - close) - (close - low)) as s, stddev_pop((high - close) - (close - low)) as sp from b group by symbol), t as (select *, mean_diff / nullif(s / sqrt(n), 0) as t, coalesce(mean_diff / nullif(sp, 0), 0) as cd from d) select symbol, n, round(mean_diff, 6) as mean_diff, round(t, 6) as t, n - 1 as df, round(cd, 6) as cohens_d, case when abs(cd) < 0.2 then 'negligible' when abs(cd) < 0.5 then 'small' when abs(cd) < 0.8 then 'medium' else 'large' end as effect, round(2 * (1 - {_cdf('abs(t)')}), 6) as p from t")
def paired_tests(b):
    d = b.select("symbol", (F.col("high") - F.col("close")).alias("above"), (F.col("close") - F.col("low")).alias("below"))
    return S.paired(d, "above", "below", ("symbol",)).select("symbol", "n", *r6(mean_diff="mean_diff", t="t"), "df", *r6(cohens_d="cohens_d"), "effect", *r6(p="p"))


_ranks = ", d as (select symbol, (high - close) - (close - low) as d from b), e as (select symbol, d, abs(d) as size from d where d <> 0), k as (select symbol, d, rank() over (partition by symbol order by size) + (count(*) over (partition by symbol, size) - 1) / 2 as rk, count(*) over (partition by symbol, size) as c from e), t as (select symbol, count(*)::double as n, sum(rk) filter (where d > 0) as plus, sum(c * c - 1)::double as ties from k group by symbol), u as (select *, least(plus, n * (n + 1) / 2 - plus) as w from t)"


@registered(_ranks + f" select symbol, n::bigint as n, w as statistic, round(2 * (1 - {_cdf('abs((w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24))')}), 6) as p from u", "hour")
def signed_rank_tests(b):
    d = b.select("symbol", (F.col("high") - F.col("close")).alias("above"), (F.col("close") - F.col("low")).alias("below"))
    return S.signed_ranks(d, "above", "below", ("symbol",)).select("symbol", "n", "statistic", *r6(p="p"))


@registered(f", d as (select symbol, close - lag(close) over ({W}) as dy, lag(close) over ({W}) as y from b), s as (select symbol, count(*) + 1 as n, regr_slope(dy, y) as slope, regr_sxx(dy, y) as sxx, regr_syy(dy, y) as syy from d where y is not null group by symbol having count(*) >= 19) select symbol, n, round(slope / sqrt((syy - slope * slope * sxx) / (n - 3) / sxx), 6) as statistic from s")
def dickey_fuller(b):
    """Tests for a unit root without lags, over days of a symbol for each user."""
    return stationarity.adf(b, lags=0).select("symbol", "n", *r6(statistic="statistic"))


@registered("", "hour")
def unit_roots(b):
    return stationarity.adf(b).select("symbol", "n", "lags", *r6(statistic="statistic", p="p"), "stationary")


del SQL["unit_roots"]  # lags are chosen among many regressions: no SQL
