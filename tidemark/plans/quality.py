"""Queries of the quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.plans.registry import W, r6, registered

LONG = ", v as (" + " union all ".join(f"select symbol, bar_ts, '{c}' as name, {c}::double as value from b" for c in Q.NUMERIC) + ")"
STEP = f", s as (select symbol, bar_ts, lag(bar_ts) over ({W}) as prev, date_diff('second', lag(bar_ts) over ({W}), bar_ts) as step from b)"
MODE = f"{STEP}, c as (select symbol, step, count(*) as n from s where step is not null group by all), m0 as (select symbol, arg_min(step, row(-n, step)) as step from c group by symbol), m as (select symbol, case when step between 60 and 86400 then step else 300 end as step from (select distinct symbol from b) left join m0 using (symbol))"


@registered(f"{LONG} select name, count(*) filter (where value is null) as n_null, round(count(*) filter (where value is null) / count(*), 6) as share, case when count(*) filter (where value is null) / count(*) > 0.05 then 'Fail' when count(*) filter (where value is null) / count(*) > 0.01 then 'Warn' else 'Pass' end as status from v group by name", "dirty")
def missing_values(b):
    return Q.missing(b).withColumn("share", r6(x="share")[0])


@registered(" select count(*) as n, (select count(*) from (select distinct * from b)) as n_distinct, count(*) - (select count(*) from (select distinct * from b)) as n_duplicate from b", "dirty")
def duplicate_rows(b):
    return Q.duplicates(b)


@registered(", d as (select distinct * from b) select symbol, count(*) as n, sum(volume)::bigint as volume from d group by symbol", "dirty")
def without_duplicates(b):
    return b.dropDuplicates().groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@registered(f"{LONG}, l as (select name, list_sort(list(value)) as x, avg(value) as mean, stddev_pop(value) as std from v where value is not null group by name), q as (select *, len(x) as n, x[len(x) // 4 + 1] as q1, x[3 * len(x) // 4 + 1] as q3 from l) select q.name, n, round(q1, 6) as q1, round(q3, 6) as q3, round(mean, 6) as mean, round(std, 6) as std, len(list_filter(x, lambda a: a < q1 - 1.5 * (q3 - q1) or a > q3 + 1.5 * (q3 - q1))) as n_iqr, len(list_filter(x, lambda a: abs(a - mean) / std > 3)) as n_z from q", "dirty")
def outlier_counts(b):
    return Q.outliers(b).select("name", "n", *r6(q1="q1", q3="q3", mean="mean", std="std"), "n_iqr", "n_z")


@registered(f"{STEP} select symbol, count(*) as n, count(*) filter (where step = 0) as n_repeated, count(*) filter (where step > 259200) as n_gap, min(step) as shortest, max(step) as longest, round(avg(step), 6) as mean_step, count(*) filter (where step <> 86400) as n_irregular, count(*) filter (where step <> 86400) = 0 as regular from s group by symbol", "dirty")
def time_steps(b):
    return Q.times(b).withColumn("mean_step", r6(x="mean_step")[0])


@registered(f"{MODE} select symbol, step from m")
def modal_steps(b):
    return Q.modal_step(b)


@registered(f"{MODE} select s.symbol, s.prev as gap_start, s.bar_ts as gap_end, s.step as seconds from s join m on s.symbol = m.symbol where s.step > 2 * m.step")
def data_gaps(b):
    return Q.gaps(b)


_rules = {n: x.replace("unix_timestamp(bar_ts)", "epoch(bar_ts)") for n, x in Q.RULES.items()}


@registered(f", o as (select *, lag(bar_ts) over ({W}, close nulls first) as last_ts from b), f as (select symbol, list_filter([{', '.join(f"case when not coalesce({x}, false) then '{n}' end" for n, x in _rules.items())}], lambda x: x is not null) as broken from o), r as (select symbol, unnest(case when len(broken) = 0 then ['none'] else broken end) as rule from f) select symbol, rule, count(*) as n from r group by all", "dirty")
def rule_breaks(b):
    return Q.broken(b)


@registered(", c as (select symbol, bar_ts, count(*) as n from b group by all having count(*) > 1) select symbol, sum(n - 1)::bigint as n_repeated from c group by symbol", "dirty")
def repeated_times(b):
    return Q.repeated_times(b)


@registered(f", d as (select symbol, bar_ts, volume, abs(close / nullif(lag(close) over ({W}), 0) - 1) as move from b), m as (select symbol, median(volume) as median_volume from b group by symbol) select symbol, round(median_volume, 6) as median_volume, count(*) filter (where move > 0.1) as n_jump, count(*) filter (where volume > 2 * median_volume) as n_volume from d join m using (symbol) group by symbol, median_volume")
def market_anomalies(b):
    return Q.market_anomalies(b, volume=2.0).withColumn("median_volume", r6(x="median_volume")[0])


_sig = f", g as (select close / nullif(lag(close) over ({W}), 0) - 1 as momentum, case when day(bar_ts) % 3 = 0 then close end as sparse_one, 1.0 as same from b)"


@registered(_sig + ", v as (" + " union all ".join(f"select '{c}' as name, {c}::double as value from g" for c in ("momentum", "sparse_one", "same")) + "), f as (select name, avg(value) as m, stddev_samp(value) as s, count(*) filter (where value is null) / count(*) > 0.2 as sparse from v group by name) select name, count(*) filter (where abs(value - m) > 3 * s) as n_far, coalesce(s, 0) = 0 as constant, sparse from v join f using (name) group by name, s, sparse")
def signal_anomalies(b):
    from tidemark.operators.bars import back

    d = b.select((F.col("close") / F.nullif(back("close"), F.lit(0.0)) - 1).alias("momentum"), F.expr("case when day(bar_ts) % 3 = 0 then close end as sparse_one"), F.lit(1.0).alias("same"))
    return Q.signal_anomalies(d, ["momentum", "sparse_one", "same"])


@registered(f"{MODE}, g as (select s.symbol, count(*) as n_gaps from s join m on s.symbol = m.symbol where s.step > 2 * m.step group by 1), a as (select symbol, avg((close > 100)::int) as missing, count(*) filter (where close > 150) as n_far from b group by symbol) select symbol, coalesce(n_gaps, 0) as n_gaps, n_far, round(greatest(0, 1 - least(missing, 0.3) - least(0.05 * n_far, 0.3) - least(0.02 * coalesce(n_gaps, 0), 0.2)), 6) as score from a left join g using (symbol)")
def quality_scores(b):
    """The score of each symbol, with bars over 100 taken as missing and bars over 150 as anomalies."""
    a = b.groupBy("symbol").agg(F.avg((F.col("close") > 100).cast("double")).alias("missing"), F.count_if(F.col("close") > 150).alias("n_far"))
    g = Q.gaps(b).groupBy("symbol").agg(F.count("*").alias("n_gaps"))
    d = a.join(g, "symbol", "left").na.fill(0, ["n_gaps"])
    return d.select("symbol", "n_gaps", "n_far", F.round(Q.score(F.col("missing"), F.col("n_far"), F.col("n_gaps")), 6).alias("score"))


@registered(f"{LONG} select name, count(*) as n, count(*) filter (where value is null) as n_null, count(*) filter (where abs(value) = 'inf'::double) as n_infinite, round(min(value), 6) as low, round(max(value), 6) as high, round(stddev_samp(value) / nullif(abs(avg(value)), 0), 6) as cv, round(count(distinct value) / count(*), 6) as unique_share, min(value) = max(value) as constant from v group by name", "dirty")
def column_metrics(b):
    return Q.metrics(b).select("name", "n", "n_null", "n_infinite", *r6(low="low", high="high", cv="cv", unique_share="unique_share"), "constant")


@registered(f"{LONG} select name, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(skewness(value), 6) as skew, round(kurtosis(value), 6) as kurtosis from v group by name")
def column_moments(b):
    return Q.moments(b).select("name", "n", *r6(mean="mean", std="std", skew="skew", kurtosis="kurtosis"))


@registered(" " + " union all ".join(f"select '{a}' as a, '{c}' as b, round(corr({a}, {c}), 6) as r from b" for i, a in enumerate(Q.NUMERIC) for c in Q.NUMERIC[i + 1 :]))
def correlation_matrix(b):
    return Q.correlations(b).withColumn("r", r6(x="r")[0])


@registered(f", c as (" + " union all ".join(f"select '{a}' as name, abs(corr({a}, {c})) as r from b" for a in Q.NUMERIC for c in Q.NUMERIC if a != c) + f"){LONG} select name, round(var_samp(value), 6) as variance, round(avg(abs(value)), 6) as mean_size, round(avg((value <> 0)::int), 6) as nonzero, round(top, 6) as top_corr, row_number() over (order by var_samp(value) desc, name) as place from v join (select name, max(r) as top from c group by name) using (name) group by name, top")
def feature_importance(b):
    """Features with their place by variance, by which the best few are selected."""
    from pyspark.sql import Window

    d = Q.importance(b, Q.NUMERIC)  # a row for each feature
    return d.select("name", *r6(variance="variance", mean_size="mean_size", nonzero="nonzero", top_corr="top_corr"), F.row_number().over(Window.orderBy(F.desc("variance"), "name")).alias("place"))


@registered(f", d as (select count(*) as n_distinct from (select distinct * from b)), s as (select date_diff('second', lag(bar_ts) over ({W}), bar_ts) as step from b){LONG}, l as (select name, list_sort(list(value)) as x from v where value is not null group by name), q as (select x, x[len(x) // 4 + 1] as q1, x[3 * len(x) // 4 + 1] as q3 from l), t as (select (select count(*) from b) as n, (select count(distinct symbol) from b) as n_symbols, (select count(*) from v where value is null) as n_null, (select count(*) from b) - (select n_distinct from d) as n_duplicate, (select count(*) from s where step = 0) as n_repeated, (select sum(len(list_filter(x, lambda a: a < q1 - 1.5 * (q3 - q1) or a > q3 + 1.5 * (q3 - q1))))::bigint from q) as n_outlier), u as (select *, case when n_null / (n * 5) > 0.05 then 'Fail' when n_null / (n * 5) > 0.01 then 'Warn' else 'Pass' end as missing_status, case when n_duplicate / n > 0.05 then 'Fail' when n_duplicate > 0 then 'Warn' else 'Pass' end as duplicate_status, case when n_repeated > 0 then 'Warn' else 'Pass' end as time_status, case when n_outlier / (n * 5) > 0.1 then 'Fail' when n_outlier > 0 then 'Warn' else 'Pass' end as outlier_status from t) select *, case when 'Fail' in (missing_status, duplicate_status, time_status, outlier_status) then 'Fail' when 'Warn' in (missing_status, duplicate_status, time_status, outlier_status) then 'Warn' else 'Pass' end as status from u", "dirty")
def validation_report(b):
    return Q.report(b)


@registered(" select symbol, count(*) as n, min(bar_ts) as first_ts, max(bar_ts) as last_ts, round(avg(close), 6) as mean_close, round(stddev_pop(close) / avg(close), 6) as volatility, round(count(close) / count(*), 6) as completeness from b group by symbol")
def data_info(b):
    return b.groupBy("symbol").agg(F.count("*").alias("n"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"), *r6(mean_close="avg(close)", volatility="stddev_pop(close) / avg(close)", completeness="count(close) / count(*)"))
