"""Queries of preparation, validation, weights, models, joins, and of the signals that hold over bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import joins
from tidemark.operators import holding as H
from tidemark.operators import preprocess as P
from tidemark.operators import validation as V
from tidemark.plans import fusion
from tidemark.plans.registry import W, r6, registered, rounded

_d = "(partition by symbol)"
_gaps = f", g as (select symbol, bar_ts, case when day(bar_ts) % 4 = 0 or day(bar_ts) < 3 then null else close end as x, row_number() over ({W})::double as i from b)"
_bef, _aft = f"over ({W} rows between unbounded preceding and current row)", f"over ({W} rows between current row and unbounded following)"


@registered(_gaps + f", f as (select *, last_value(x ignore nulls) {_bef} as a, first_value(x ignore nulls) {_aft} as c, last_value(case when x is not null then i end ignore nulls) {_bef} as ia, first_value(case when x is not null then i end ignore nulls) {_aft} as ic, avg(x) over {_d} as m from g) select symbol, bar_ts, round(coalesce(a, c), 6) as x_forward, round(coalesce(c, a), 6) as x_backward, round(coalesce(x, a + (c - a) * (i - ia) / nullif(ic - ia, 0), a, c), 6) as x_linear, round(coalesce(x, m), 6) as x_mean from f")
def filled_values(b):
    d = b.select("symbol", "bar_ts", F.expr("case when day(bar_ts) % 4 = 0 or day(bar_ts) < 3 then null else close end as x"))
    return P.with_filled(d, "x").select("symbol", "bar_ts", *r6(**{f"x_{h}": f"x_{h}" for h in ("forward", "backward", "linear", "mean")}))


@registered(f", g as (select symbol, bar_ts, close as x, close - 1 as y, row_number() over ({W})::double - 1 as i, min(close) over {_d} as lx, min(close - 1) over {_d} as ly from b), l as (select symbol, regr_slope(x, i) as s, regr_intercept(x, i) as t from g group by symbol) select symbol, bar_ts, round(case when lx > 0 then ln(1 + x) else x end, 6) as log_x, round(case when ly > 0 then ln(1 + y) else y end, 6) as log_y, round(x - coalesce(s * i + t, x), 6) as detrended from g join l using (symbol)")
def transformed_values(b):
    d = b.select("symbol", "bar_ts", F.col("close").alias("x"), (F.col("close") - 1).alias("y"))
    d = P.detrended(d.withColumn("detrended", F.col("x")), "detrended")
    return P.logged(d, ["x", "y"]).select("symbol", "bar_ts", *r6(log_x="x", log_y="y", detrended="detrended"))


@registered(f", q as (select symbol, avg(close) as m, stddev_samp(close) as s, quantile_cont(close, 0.25) as a, quantile_cont(close, 0.75) as c from b group by symbol), k as (select b.*, m - 1.5 * s as zl, m + 1.5 * s as zh, a - (c - a) as il, c + (c - a) as ih from b join q using (symbol)), r as (select *, case when close between zl and zh then close end as kept from k) select symbol, bar_ts, round(least(greatest(close, zl), zh), 6) as by_z, round(least(greatest(close, il), ih), 6) as by_iqr, round(coalesce(last_value(kept ignore nulls) {_bef}, first_value(kept ignore nulls) {_aft}), 6) as removed from r")
def clipped_values(b):
    d = b.select("symbol", "bar_ts", F.col("close").alias("by_z"), F.col("close").alias("by_iqr"), F.col("close").alias("removed"))
    d = P.clipped(P.clipped(d, "by_z", P.bounds(d, "by_z", "zscore", 1.5)), "by_iqr", P.bounds(d, "by_iqr", "iqr", 1.0))
    return P.clipped(d, "removed", P.bounds(d, "removed", "zscore", 1.5), remove=True).select("symbol", "bar_ts", *r6(by_z="by_z", by_iqr="by_iqr", removed="removed"))


@registered(", q as (select symbol, avg(close) as m, stddev_pop(close) as s, min(close) as lo, max(close) as hi, quantile_cont(close, 0.25) as a, median(close) as d, quantile_cont(close, 0.75) as c from b group by symbol) select symbol, bar_ts, round((close - m) / case when s = 0 then 1 else s end, 6) as standard, round((close - lo) / case when hi = lo then 1 else hi - lo end, 6) as minmax, round((close - d) / case when c = a then 1 else c - a end, 6) as robust from b join q using (symbol)")
def scaled_values(b):
    d = b.select("symbol", "bar_ts", "close")
    for how in ("standard", "minmax", "robust"):
        d = P.scaled(d, "close", P.scale(b, "close", how), how)
    return d.select("symbol", "bar_ts", *r6(standard="standard", minmax="minmax", robust="robust"))


@registered(f", f as (select symbol, bar_ts, close, avg(close) over w as m, stddev_samp(close) over w as s, count(*) over w as n from b window w as ({W} rows between 4 preceding and current row)), l as (select symbol, bar_ts, case when min(close) over (partition by symbol) > 0 then ln(1 + close) else close end as x from f), q as (select symbol, avg(x) - 3 * stddev_samp(x) as lo, avg(x) + 3 * stddev_samp(x) as hi from l group by symbol), c as (select symbol, bar_ts, case when x < lo then lo when x > hi then hi else x end as x from l join q using (symbol)), z as (select symbol, avg(x) as m, stddev_pop(x) as s from c group by symbol) select symbol, bar_ts, round((x - m) / case when s = 0 then 1 else s end, 6) as close from c join z using (symbol)")
def prepared_closes(b):
    """The whole pipeline, learned and replayed."""
    return P.Pipeline("close").fit(b).apply(b).select("symbol", "bar_ts", *r6(close="close"))


FOLDS = f", r as (select symbol, bar_ts, (close / nullif(lag(close) over ({W}), 0) - 1) as raw from b), x as (select symbol, bar_ts, raw / (1 + abs(raw)) as r from r where raw is not null), p as (select *, least(floor((row_number() over ({W}) - 1) / greatest(floor(count(*) over {_d} / 4), 1)), 3)::int as p from x), f as (select symbol, bar_ts, r, p, unnest(range(greatest(p - 1, 0), 3))::int as fold from p), e as (select symbol, bar_ts, r, fold, case when p = fold + 1 then 'test' else 'train' end as part from f where p <= fold + 1), c as (select *, sum(r) over (partition by symbol, fold, part order by bar_ts) as cum from e), d as (select *, max(cum) over (partition by symbol, fold, part order by bar_ts) - cum as dd from c), m as (select symbol, fold, part, count(*) as n, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) as sharpe, sum(r) as total, coalesce(stddev_samp(r) * sqrt(252), 0) as volatility, max(dd) as max_drawdown, avg((r > 0)::int) as win_rate from d group by all)"


def fold_metrics(b):
    raw = F.col("close") / F.nullif(B.back("close"), F.lit(0.0)) - 1
    d = b.select("symbol", "bar_ts", raw.alias("raw")).where("raw is not null").select("symbol", "bar_ts", (F.col("raw") / (1 + F.abs("raw"))).alias("r"))
    return V.strategy_metrics(V.expanding(d, 3), "r", ("symbol", "fold", "part"))


@registered(FOLDS + " select symbol, fold, part, n, round(sharpe, 6) as sharpe, round(total, 6) as total, round(volatility, 6) as volatility, round(max_drawdown, 6) as max_drawdown, round(win_rate, 6) as win_rate from m")
def fold_performance(b):
    return fold_metrics(b).select("symbol", "fold", "part", "n", *r6(sharpe="sharpe", total="total", volatility="volatility", max_drawdown="max_drawdown", win_rate="win_rate"))


@registered(FOLDS + ", s as (select symbol, fold, max(sharpe) filter (where part = 'train') as a, max(sharpe) filter (where part = 'test') as c from m group by all), l as (select *, (a - c) / nullif(abs(a), 0) as lost from s), k as (select symbol, count(*) as n_folds, avg(a) as in_sample, avg(c) as out_of_sample, avg(lost) as lost_mean, stddev_samp(lost) as lost_std, min(lost) as lost_least, max(lost) as lost_most, avg((c > 0)::int) as positive, stddev_pop(c) as sp, regr_slope(c, fold) as trend from l group by symbol) select symbol, n_folds, round(in_sample, 6) as in_sample, round(out_of_sample, 6) as out_of_sample, round(lost_mean, 4) as lost_mean, round(lost_std, 4) as lost_std, round(lost_least, 4) as lost_least, round(lost_most, 4) as lost_most, round(positive, 6) as positive, round(trend, 6) as trend, round(greatest(1 - sp / nullif(abs(out_of_sample), 0), 0), 5) as stability, coalesce(lost_mean > 0.3 or lost_most > 0.45, false) as overfit from k")
def fold_report(b):
    d = V.fold_report(fold_metrics(b))
    return d.select("symbol", "n_folds", *r6(in_sample="in_sample", out_of_sample="out_of_sample", positive="positive", trend="trend"), *rounded(4, lost_mean="lost_mean", lost_std="lost_std", lost_least="lost_least", lost_most="lost_most"), *rounded(5, stability="stability"), "overfit")


@registered(", r as (select min(bar_ts) as a, max(bar_ts) as z from b), w as (select cast(row_number() over (order by s) - 1 as int) as win, s as train_start, s + interval 10 day as train_end, s + interval 14 day as test_end from (select unnest(generate_series(a, z, interval 4 day)) as s, z from r) where s + interval 14 day <= z) select win as \"window\", symbol, case when bar_ts < train_end then 'train' else 'test' end as part, count(*) as n, round(avg(close), 6) as mean from b join w on bar_ts >= train_start and bar_ts < test_end group by all")
def walk_forward(b):
    ends = b.agg(F.min("bar_ts"), F.max("bar_ts")).first()
    w = V.windows(b.sparkSession, *ends, "10D", "4D", "4D")
    return V.windowed(b, w).groupBy("window", "symbol", "part").agg(F.count("*").alias("n"), F.avg("close").alias("mean")).select("window", "symbol", "part", "n", *r6(mean="mean"))


@registered(", r as (select min(bar_ts) as a, max(bar_ts) as z from b), w as (select cast(row_number() over (order by s) - 1 as int) as win, s + interval 10 day as test_start, s + interval 14 day as test_end from (select unnest(generate_series(a, z, interval 4 day)) as s, z from r) where s + interval 14 day <= z), m as (select win, symbol, avg(close) as mean from b join w on bar_ts >= test_start and bar_ts < test_end group by all), l as (select *, lag(mean) over (partition by symbol order by win) as prev from m) select win as \"window\", symbol, round(mean, 6) as mean, coalesce((prev - mean) / nullif(abs(prev), 0) > 0.2, false) as retrain from l")
def retraining(b):
    ends = b.agg(F.min("bar_ts"), F.max("bar_ts")).first()
    w = V.windows(b.sparkSession, *ends, "10D", "4D", "4D")
    d = V.windowed(b, w).where("part = 'test'").groupBy("window", "symbol").agg(F.avg("close").alias("mean"))
    return V.retrained(d, "mean").select("window", "symbol", *r6(mean="mean"), "retrain")


@registered(f", d as (select *, avg(close) over w as baseline, stddev_samp(close) over w as sd, count(*) over w as n from b window w as ({W} rows between 5 preceding and 1 preceding)), c as (select *, (close - baseline) / nullif(abs(baseline), 0) as change, (close - baseline) / nullif(sd / sqrt(n), 0) as t from d) select symbol, bar_ts, round(baseline, 6) as baseline, round(change, 6) as change, round(t, 5) as t, n >= 5 and coalesce(change < -0.1, false) and coalesce(abs(t) > 2, false) as alert from c")
def regression_alerts(b):
    return V.regressions(b, "close").select("symbol", "bar_ts", *r6(baseline="baseline", change="change"), *rounded(5, t="t"), "alert")


_grid = V.simplex(3, 5)


@registered(fusion.ROWS + f", y as (select symbol, bar_ts, s_ldc, s_mr, s_tsmom, lead(close) over ({W}) / nullif(close, 0) - 1 as raw from k), z as (select *, raw / (1 + abs(raw)) as r from y where raw is not null), gr as (select * from (values {', '.join(f'({i}, {a}::double, {c}::double, {d}::double)' for i, (a, c, d) in enumerate(_grid))}) as t(g, w0, w1, w2)), p as (select symbol, gr.g as g, w0, w1, w2, sign(s_ldc * w0 + s_mr * w1 + s_tsmom * w2) * r as p, r from z, gr), e as (select symbol, g, w0, w1, w2, count(*) as n, round(coalesce(avg(p) / nullif(stddev_samp(p), 0) * sqrt(252), 0), 9) as sharpe, stddev_samp(r) as v from p group by all), o as (select *, row_number() over (partition by symbol order by sharpe desc, g) as o from e) select symbol, n, case when n >= 20 and v > 0 then w0 else round(1 / 3.0::double, 6) end as w_0, case when n >= 20 and v > 0 then w1 else round(1 / 3.0::double, 6) end as w_1, case when n >= 20 and v > 0 then w2 else round(1 / 3.0::double, 6) end as w_2, case when n >= 20 and v > 0 then round(sharpe, 6) end as sharpe from o where o = 1")
def grid_weights(b):
    raw = F.lead("close").over(B.by_symbol()) / F.nullif("close", F.lit(0.0)) - 1
    d = fusion.known(b).withColumn("raw", raw).where("raw is not null").withColumn("r", F.col("raw") / (1 + F.abs("raw")))
    return V.grid_weights(d, ["s_ldc", "s_mr", "s_tsmom"], steps=5, least_rows=20).select("symbol", "n", *r6(w_0="w_0", w_1="w_1", w_2="w_2", sharpe="sharpe"))


MODELS = ", m as (select symbol, 'model' || (day(bar_ts) % 3)::varchar as model, avg(close) as a, stddev_pop(close) as c from b group by all)"


def models(b):
    return b.groupBy("symbol", F.concat(F.lit("model"), F.expr("day(bar_ts) % 3").cast("string")).alias("model")).agg(F.avg("close").alias("a"), F.stddev_pop("close").alias("c"))


@registered(MODELS + ", n as (select *, coalesce((a - min(a) over w) / nullif(max(a) over w - min(a) over w, 0), 1) as na, coalesce(1 - (c - min(c) over w) / nullif(max(c) over w - min(c) over w, 0), 1) as nc from m window w as (partition by symbol)), s as (select *, case when a < 30 then '-inf'::double else na * 0.6 + nc * 0.4 end as score from n) select symbol, model, case when score > -1 then round(score, 6) + 0 end as score, row_number() over (partition by symbol order by score desc, model) as place from s")
def model_selection(b):
    d = V.selected(models(b), {"a": 0.6, "c": 0.4}, lower=("c",), thresholds={"a": 30.0})
    return d.select("symbol", "model", *r6(score="case when score > -1 then score end"), "place")


@registered(", g as (select symbol, day(bar_ts) % 3 as p, day(bar_ts) % 2 as q, avg(close) as v from b group by all), r as (select *, v - (avg(v) over (partition by symbol, p) + avg(v) over (partition by symbol, q) - avg(v) over (partition by symbol)) as rest from g) select symbol, round(coalesce(var_pop(rest) / nullif(var_pop(v), 0), 0), 6) as strength from r group by symbol")
def parameter_interaction(b):
    g = b.groupBy("symbol", F.expr("day(bar_ts) % 3").alias("p"), F.expr("day(bar_ts) % 2").alias("q")).agg(F.avg("close").alias("v"))
    return V.interaction(g, "p", "q", "v", ("symbol",)).select("symbol", *r6(strength="strength"))


MEMBERS = fusion.ROWS + ", e as (" + " union all ".join(f"select symbol, bar_ts, '{c}' as member, {w}::double as weight, (1 + {c}) / 2 as p_0, 1 - (1 + {c}) / 2 as p_1 from k" for c, w in (("s_ldc", 0.5), ("s_mr", 0.2), ("s_tsmom", 0.3))) + "), o as (select *, case when p_0 >= p_1 then 0 else 1 end as own from e)"


def members(b):
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("member"), F.lit(w).alias("weight"), ((1 + F.col(c)) / 2).alias("p_0"), (1 - (1 + F.col(c)) / 2).alias("p_1")) for c, w in (("s_ldc", 0.5), ("s_mr", 0.2), ("s_tsmom", 0.3))]))
    return fusion.known(b).select("symbol", "bar_ts", rows.alias("x")).select("symbol", "bar_ts", "x.*")


@registered(MEMBERS + ", a as (select symbol, bar_ts, sum(p_0 * weight) / sum(weight) as p_0, sum(p_1 * weight) / sum(weight) as p_1, list(own) as owns from o group by all), s as (select *, case when p_0 >= p_1 then 0 else 1 end as state from a) select symbol, bar_ts, round(p_0, 6) as p_0, round(p_1, 6) as p_1, state, round(len(list_filter(owns, lambda x: x = state)) / len(owns), 6) as agreement from s where abs(p_0 - p_1) > 1e-9")
def ensemble_states(b):
    return V.ensemble(members(b)).where("abs(p_0 - p_1) > 1e-9").select("symbol", "bar_ts", *r6(p_0="p_0", p_1="p_1"), "state", *r6(agreement="agreement"))


@registered(MEMBERS + " select x.symbol, x.member as a, y.member as b, round(avg((x.own <> y.own)::int), 6) as share from o x join o y on x.symbol = y.symbol and x.bar_ts = y.bar_ts and x.member < y.member group by all")
def member_disagreement(b):
    d = members(b).withColumn("state", F.when(F.col("p_0") >= F.col("p_1"), 0).otherwise(1))
    return V.disagreement(d).select("symbol", "a", "b", *r6(share="share"))


@registered(", v as (select symbol, 'v' || (1 + volume % 2)::varchar || '.' || day(bar_ts)::varchar || '.' || (day(bar_ts) % 11)::varchar as version from b) select symbol, arg_max(version, list_transform(string_split(substr(version, 2), '.'), lambda x: x::int)) as version from v group by symbol")
def latest_versions(b):
    d = b.select("symbol", F.expr("concat('v', 1 + volume % 2, '.', day(bar_ts), '.', day(bar_ts) % 11)").alias("version"))
    return V.latest(d, ("symbol",))


@registered(", x as (select symbol, bar_ts, close from b where day(bar_ts) % 3 <> 0), y as (select symbol, bar_ts, volume from b where day(bar_ts) % 4 <> 0) select coalesce(x.symbol, y.symbol) as symbol, coalesce(x.bar_ts, y.bar_ts) as bar_ts, close, volume from x full join y on x.symbol = y.symbol and x.bar_ts = y.bar_ts")
def outer_joined(b):
    x, y = b.where("day(bar_ts) % 3 <> 0").select("symbol", "bar_ts", "close"), b.where("day(bar_ts) % 4 <> 0").select("symbol", "bar_ts", "volume")
    return joins.combined({"x": x, "y": y})


@registered(", x as (select symbol, bar_ts from b where day(bar_ts) % 3 <> 0), y as (select symbol, bar_ts from b where day(bar_ts) % 4 <> 0) select x.symbol, round(avg((y.symbol is not null)::int), 6) as covered, avg((y.symbol is not null)::int) < 0.8 as sparse from x left join y on x.symbol = y.symbol and x.bar_ts = y.bar_ts group by x.symbol")
def signal_coverage(b):
    return joins.coverage(b.where("day(bar_ts) % 3 <> 0"), b.where("day(bar_ts) % 4 <> 0")).select("symbol", *r6(covered="covered"), "sparse")


@registered(", x as (select symbol, bar_ts, close from b where symbol <> '1' and day(bar_ts) > 3), y as (select symbol, bar_ts, volume from b where symbol <> '2' and day(bar_ts) < 20), s as (select greatest((select min(bar_ts) from x), (select min(bar_ts) from y)) as lo, least((select max(bar_ts) from x), (select max(bar_ts) from y)) as hi) select symbol, bar_ts, close from x, s where symbol in (select symbol from y) and bar_ts between lo and hi")
def aligned_signals(b):
    return joins.aligned(b.where("symbol <> '1' and day(bar_ts) > 3").select("symbol", "bar_ts", "close"), b.where("symbol <> '2' and day(bar_ts) < 20").select("symbol", "bar_ts", "volume"))[0]


@registered(", x as (select symbol, sum(volume)::double as quantity from b group by symbol), y as (select symbol, sum(volume)::double + case when symbol like '%1' then 1 else 0 end as quantity from b where symbol not like '%7' group by symbol union all select 'new', 3.0) select coalesce(x.symbol, y.symbol) as symbol, coalesce(x.quantity, 0) as expected, coalesce(y.quantity, 0) as actual, coalesce(y.quantity, 0) - coalesce(x.quantity, 0) as diff from x full join y on x.symbol = y.symbol where abs(coalesce(y.quantity, 0) - coalesce(x.quantity, 0)) > 1e-6")
def reconciled_positions(b):
    x = b.groupBy("symbol").agg(F.sum("volume").cast("double").alias("quantity"))
    y = x.where("symbol not like '%7'").withColumn("quantity", F.col("quantity") + F.when(F.col("symbol").like("%1"), 1).otherwise(0))
    return joins.reconciled(x, y.unionByName(x.sparkSession.createDataFrame([("new", 3.0)], y.schema)))


@registered(f", p as (select *, close - lag(close, 4) over ({W}) as move, row_number() over ({W}) as i from b), r as (select symbol, bar_ts, close, i, case when abs(move) > 10 then sign(move)::int end as raw from p), h as (select *, last_value(raw ignore nulls) over ({W} rows between unbounded preceding and current row) as side from r), c as (select *, case when side is distinct from lag(side) over ({W}) then 1 else 0 end as turn from h), g as (select *, sum(turn) over ({W}) as run, sum(turn) over ({W} rows between 3 preceding and 1 preceding) as before, avg(close) over ({W} rows between 19 preceding and current row) as sma from c), e as (select *, row_number() over (partition by symbol, run order by bar_ts) - 1 as held from g) select symbol, bar_ts, side, held, turn = 1 and coalesce(before, 0) > 0 and side is not null as early_flip, close > sma as up_trend, turn = 1 and side = 1 and close > sma as enter_long, turn = 1 and side = -1 and close < sma as enter_short, held = 4 as strict_exit, i - last_value(case when turn = 1 then i end ignore nulls) over ({W} rows between unbounded preceding and current row) as bars_since from e")
def held_signals(b):
    move = F.col("close") - B.back("close", 4)
    return H.held(b.withColumn("raw", F.when(F.abs(move) > 10, F.signum(move).cast("int"))))


def _kern(weights):
    lags = [f"lag(close, {i}) over o" for i in range(len(weights))]
    return f"({' + '.join(f'coalesce({v} * {x!r}::double, 0)' for v, x in zip(lags, weights))}) / ({' + '.join(f'(case when {v} is null then 0 else {x!r}::double end)' for v, x in zip(lags, weights))})"


@registered(f", k as (select symbol, bar_ts, {_kern(B.rational_quadratic())} as y1, {_kern(B.gaussian(6.0))} as y2 from b window o as ({W})), l as (select *, lag(y1) over ({W}) as y1a, lag(y1, 2) over ({W}) as y1b, lag(y2) over ({W}) as y2a from k) select symbol, bar_ts, y1 > y1a as rising, y1 > y1a and y1a < y1b as turned_up, y1 < y1a and y1a > y1b as turned_down, y2 >= y1 as above, y2 > y1 and y2a <= y1a as crossed_up, y2 < y1 and y2a >= y1a as crossed_down from l where y1b is not null and abs(y1 - y1a) > 1e-9 and abs(y1a - y1b) > 1e-9 and abs(y2 - y1) > 1e-9 and abs(y2a - y1a) > 1e-9")
def kernel_crossings(b):
    """Without bars whose kernels are next to equal, where rounding decides."""
    d = H.kernel_turns(b).where("y1_2 is not null and abs(y1 - y1_1) > 1e-9 and abs(y1_1 - y1_2) > 1e-9 and abs(y2 - y1) > 1e-9 and abs(y2_1 - y1_1) > 1e-9")
    return d.select("symbol", "bar_ts", "rising", "turned_up", "turned_down", "above", "crossed_up", "crossed_down")


@registered(f", r as (select symbol, bar_ts, close, volume from b where close > 100), l as (select *, row_number() over (partition by symbol order by close desc, bar_ts) as o from r) select symbol, bar_ts, close, o::int as place from l where o <= 3")
def top_bars(b):
    """Filtered, sorted and cut to a few a symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("close"), "bar_ts")
    return b.where("close > 100").withColumn("place", F.row_number().over(w)).where("place <= 3").select("symbol", "bar_ts", "close", "place")


