"""Queries of features, signals, snapshots and research features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as T
from tidemark.operators import recurrences
from tidemark.plans.registry import W, r6, registered, rounded

F20 = f"({W} rows between 19 preceding and current row)"


def ew(alpha: str, c: str) -> str:
    return f"list_reduce(list({c}) over ({W} rows between unbounded preceding and current row), lambda a, v: (1 - {alpha}) * a + {alpha} * v)"


FEATURES = f""", p as (select *, (high + low + close) / 3 as tp, lag(close) over o as pc, lag(high) over o as ph, lag(low) over o as pl, row_number() over o as i from b window o as ({W})),
m as (select *, coalesce(greatest(close - pc, 0), 0) as gain, coalesce(greatest(pc - close, 0), 0) as loss, case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr, coalesce(high - ph, 0) as um, coalesce(pl - low, 0) as dm, avg(tp) over {F20} as tpm from p),
e as (select *, {ew('(1 / 14.0::double)', 'gain')} as g, {ew('(1 / 14.0::double)', 'loss')} as l, {ew('(2 / 21.0::double)', 'close')} as ema_20, {ew('(2 / 21.0::double)', 'tp')} as esa, {ew('(1 / 20.0::double)', 'tr')} as trs, {ew('(1 / 20.0::double)', '(case when um > dm and um > 0 then um else 0 end)')} as pds, {ew('(1 / 20.0::double)', '(case when dm > um and dm > 0 then dm else 0 end)')} as mds, avg(abs(tp - tpm)) over {F20} as tdev, count(*) over {F20} as n, avg(close) over {F20} as sma_20, stddev_samp(close) over {F20} as std_20 from m),
x as (select *, {ew('(2 / 21.0::double)', 'abs(tp - esa)')} as dev, case when trs > 1e-10 then 100 * pds / trs else 0 end as dip, case when trs > 1e-10 then 100 * mds / trs else 0 end as dim from e),
y as (select *, case when dev <= 1e-8 then 0 else (tp - esa) / (0.015 * dev) end as ci, case when i < 20 then 0 when dip + dim > 1e-10 then 100 * abs(dip - dim) / (dip + dim) else 0 end as dx from x),
z as (select *, {ew('(2 / 15.0::double)', 'ci')} as wavetrend_1, {ew('(1 / 20.0::double)', 'dx')} as adx0 from y),
f as (select *, {ew('0.4::double', 'wavetrend_1')} as wavetrend_2, case when i >= 20 then adx0 end as adx, case when l <= 1e-10 then 100 else 100 - 100 / (1 + g / l) end as rsi, (close - sma_20) / nullif(std_20, 0) as zscore_20, case when pc is null or pc = 0 then 0 else close / pc - 1 end as momentum, case when n >= 10 and tdev * 0.015 > 1e-10 then (tp - tpm) / (0.015 * tdev) end as cci from z)"""


@registered(FEATURES + f" select symbol, bar_ts, {', '.join(f'round({c}, 6) as {c}' for c in T.NAMES)} from f")
def features(b):
    return T.features(b).select("symbol", "bar_ts", *r6(**{c: c for c in T.NAMES}))


_bad = ", ".join(f"case when not ({x}) then '{n}' end" for n, x in T.RANGES.items())


@registered(FEATURES + f", q as (select unnest([{_bad}]) as feature from f) select feature, count(*) as n from q where feature is not null group by 1")
def feature_ranges(b):
    return T.out_of_range(T.features(b)).select(F.explode("faults").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


@registered(FEATURES + ", s as (select symbol, bar_ts, -zscore_20 / greatest(std_20, 1e-8) as m, momentum as t from f) select symbol, bar_ts, round(case when abs(m) < 0.1 then 0 else m end, 6) as s_mr, round(case when abs(t) < 0.01 then 0 else t end, 6) as s_tsmom from s")
def banded_signals(b):
    return T.signals(T.levels(b)).select("symbol", "bar_ts", *r6(s_mr="s_mr", s_tsmom="s_tsmom"))


@registered(FEATURES + ", v as (select symbol, bar_ts, rsi is not null and wavetrend_1 is not null and cci is not null and adx is not null and wavetrend_2 is not null as whole, [rsi::float::double, wavetrend_1::float::double, cci::float::double, adx::float::double, wavetrend_2::float::double] as v, [coalesce(rsi, 50)::float::double, coalesce(wavetrend_1, 0)::float::double, coalesce(cci, 0)::float::double, coalesce(adx, 25)::float::double, coalesce(momentum, 0)::float::double] as d from f) select symbol, bar_ts, round(case when whole then list_sum(v) end, 4) + 0 as v_sum, round(list_sum(d), 4) + 0 as d_sum, case when whole then 5 end as v_size from v")
def neighbour_vectors(b):
    """Sums and size of the vectors, with and without defaults."""
    d = T.features(b).select("symbol", "bar_ts", T.vector().alias("v"), T.vector("momentum", defaults=True).alias("d"))
    total = lambda c: F.aggregate(F.transform(c, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return d.select("symbol", "bar_ts", *rounded(4, v_sum=total("v"), d_sum=total("d")), F.when(F.col("v").isNotNull(), F.size("v")).alias("v_size"))


SNAP = f", d as (select distinct * from b), k as (select *, avg(close) over {F20} as sma_20, stddev_samp(close) over {F20} as std_20, case when lag(close) over ({W}) is null or lag(close) over ({W}) = 0 then 0 else close / lag(close) over ({W}) - 1 end as momentum, (lead(close, 4) over ({W}) - close) / nullif(close, 0) as future_return, count(*) over (partition by symbol) as many from d), s as (select *, case when future_return > 0.02 then 'Buy' when future_return < -0.02 then 'Sell' when future_return is not null then 'Hold' end as label from k where many >= 24)"


@registered(SNAP + " select symbol, bar_ts, open, high, low, close, volume, round(sma_20, 6) as sma_20, round(std_20, 6) as std_20, round(momentum, 6) as momentum, round(future_return, 6) as future_return, label, round(case label when 'Buy' then abs(future_return - 0.02) when 'Sell' then abs(future_return + 0.02) when 'Hold' then least(abs(future_return - 0.02), abs(future_return + 0.02)) end, 6) as label_confidence from s")
def snapshot(b):
    return T.snapshot(b).select("symbol", "bar_ts", "open", "high", "low", "close", "volume", *r6(sma_20="sma_20", std_20="std_20", momentum="momentum", future_return="future_return"), "label", *r6(label_confidence="label_confidence"))


@registered(SNAP + ", a as (select count(*) as n, count(label) as n_labelled, count(*) filter (where label = 'Buy') as n_buy, count(*) filter (where label = 'Sell') as n_sell, count(*) filter (where label = 'Hold') as n_hold, min(bar_ts) as first_ts, max(bar_ts) as last_ts from s) select n, n_labelled, n_buy, n_sell, n_hold, first_ts, last_ts, round(n_buy / n_labelled, 6) as share_buy, round(n_sell / n_labelled, 6) as share_sell, round(n_hold / n_labelled, 6) as share_hold, greatest(n_buy, n_sell, n_hold) / n_labelled <= 0.7 as balanced, 'snapshot_h4_' || strftime(first_ts, '%Y%m%d') || '_' || strftime(last_ts, '%Y%m%d') as id from a")
def snapshot_info(b):
    return T.snapshot_info(T.snapshot(b)).withColumns({c: F.round(c, 6) for c in ("share_buy", "share_sell", "share_hold")})


@registered(f", m as (select symbol, bar_ts, row_number() over ({W}) - 1 as bar_index, (lead(close, 4) over ({W}) - close) / nullif(close, 0) as move from b) select symbol, bar_ts, bar_index, round(move, 6) as move, case when move > 0.001 then 1 when move < -0.001 then -1 else 0 end as label from m where move is not null")
def training_samples(b):
    return T.training_rows(b).withColumn("move", r6(x="move")[0])


def _full(x: str, n: int, c: str = "close") -> str:
    return f"case when count({c}) over ({W} rows between {n - 1} preceding and current row) >= {n} then {x} end"


def _over(x: str, n: int) -> str:
    return f"{x} over ({W} rows between {n - 1} preceding and current row)"


_research = {f"mean_{n}": _full(_over("avg(close)", n), n) for n in (5, 10, 20)}
_research |= {f"std_{n}": _full(_over("stddev_samp(close)", n), n) for n in (5, 10, 20)}
_research |= {f"z_{n}": _full(f"(close - {_over('avg(close)', n)}) / nullif({_over('stddev_samp(close)', n)}, 0)", n) for n in (5, 10, 20)}
_research |= {f"roc_{n}": f"close / nullif(lag(close, {n}) over ({W}), 0) - 1" for n in (5, 10)} | {f"momentum_{n}": f"close - lag(close, {n}) over ({W})" for n in (5, 10)}
_research |= {f"volatility_{n}": _full(_over("stddev_samp(return_1)", n), n, "return_1") for n in (10, 20)}
_research |= {"range_10": _full(f"{_over('max(close)', 10)} - {_over('min(close)', 10)}", 10)} | {f"lag_{k}": f"lag(close, {k}) over ({W})" for k in (1, 2, 3)}
_research |= {"return_1": "return_1", "log_return": "log_return"}


@registered(f", r as (select *, close / nullif(lag(close) over ({W}), 0) - 1 as return_1, case when close > 0 and lag(close) over ({W}) > 0 then ln(close / lag(close) over ({W})) end as log_return from b) select symbol, bar_ts, {', '.join(f'round({x}, 6) as {c}' for c, x in _research.items())} from r")
def research_features(b):
    return T.research(b).select("symbol", "bar_ts", *r6(**{c: c for c in _research}))


_w14, _w13 = f"({W} rows between 13 preceding and current row)", f"({W} rows between 12 preceding and current row)"


@registered(f""", p as (select *, (high + low + close) / 3 as tp, close - lag(close) over o as move, greatest(high - low, abs(high - lag(close) over o), abs(low - lag(close) over o)) as tr, high - lag(high) over o as um, lag(low) over o - low as dm from b window o as ({W})),
a as (select *, avg(greatest(move, 0)) filter (where move is not null) over {_w13} as gain, avg(greatest(-move, 0)) filter (where move is not null) over {_w13} as loss, avg(close) over {_w14} as sma, list(close) over {_w14} as cl, list(tp) over {_w14} as tl, stddev_pop(close) over {_w14} as std, avg(tp) over {_w14} as mean, sum(case when um > dm and um > 0 then um else 0 end) over {_w13} as plus, sum(tr) over {_w13} as trs, count(*) over {_w14} as n from p),
d as (select *, list_sum(list_transform(tl, lambda x: abs(x - mean))) / 14 as dev, list_reduce(cl, lambda x, y: (1 - 2 / 15.0::double) * x + 2 / 15.0::double * y) as ema from a)
select symbol, bar_ts, {', '.join(f'round(case when n = 14 then {x} end, 6) as {c}' for c, x in {'rsi': 'case when loss = 0 then 100 else 100 - 100 / (1 + gain / loss) end', 'sma': 'sma', 'ema': 'ema', 'std': 'std', 'cci': 'case when dev > 0 then least(greatest((tp - mean) / (0.015 * dev), -500), 500) else 0 end', 'adx': 'case when trs > 0 then plus / trs * 100 else 0 end', 'wt1': '(tp - mean) / mean * 100', 'wt2': '(tp - mean) / mean * 80'}.items())} from d""")
def simplified_features(b):
    return T.simplified(b).select("symbol", "bar_ts", *r6(**{c: c for c in ("rsi", "sma", "ema", "std", "cci", "adx", "wt1", "wt2")}))


_fit = lambda i, x: " + ".join(f"{w} * c[{i} + {k}]" for k, w in enumerate(x))


@registered(f""", l as (select symbol, list(close order by bar_ts) as c, list(bar_ts order by bar_ts) as t from b group by symbol), i as (select symbol, c, t, len(c) as n, unnest(range(1, len(c) + 1)) as i from l)
select symbol, t[i] as bar_ts, round(case when n < 5 then c[i] when i = 1 then ({_fit('1', (31, 9, -3, -5, 3))}) / 35 when i = 2 then ({_fit('1', (9, 13, 12, 6, -5))}) / 35 when i = n then ({_fit('n - 4', (3, -5, -3, 9, 31))}) / 35 when i = n - 1 then ({_fit('n - 4', (-5, 6, 12, 13, 9))}) / 35 else ({_fit('i - 2', (-3, 12, 17, 12, -3))}) / 35 end, 6) as smooth from i""")
def smoothed_closes(b):
    return T.smoothed(b).select("symbol", "bar_ts", *r6(smooth="smooth"))


@registered(f""", p as (select *, coalesce(lag(close) over o, close) as pc, coalesce(lag(high) over o, high) as ph, coalesce(lag(low) over o, low) as pl, row_number() over o as i from b window o as ({W})),
m as (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr, case when high - ph > pl - low then greatest(high - ph, 0) else 0 end as pd, case when pl - low > high - ph then greatest(pl - low, 0) else 0 end as md from p),
k as (select symbol, bar_ts, i, close, pc, high, low, tr, pd, md, avg(tr) over ({W} rows between 9 preceding and current row) as atr10, count(*) over ({W} rows between 9 preceding and current row) as n from m),
s as (select symbol, i, tr as ts, pd as ps, md as ms, 0.2::double * (close - pc) as v1, 0.1::double * (high - low) as v2, 0.0::double as curve0, 0.0::double as mean0, close from k where i = 1
 union all select k.symbol, k.i, s.ts * (13 / 14.0::double) + k.tr, s.ps * (13 / 14.0::double) + k.pd, s.ms * (13 / 14.0::double) + k.md, 0.2::double * (k.close - k.pc) + 0.8::double * s.v1, 0.1::double * (k.high - k.low) + 0.8::double * s.v2, 0.0::double, 0.0::double, k.close from s join k on s.symbol = k.symbol and k.i = s.i + 1),
a as (select *, case when v2 = 0 then 0 else abs(v1 / v2) end as w from s), g as (select *, (-(w ** 2) + sqrt(w ** 4 + 16 * w ** 2)) / 8 as al from a),
c as (select symbol, i, al * close as curve, al * close as slope from g where i = 1 union all select g.symbol, g.i, g.al * g.close + (1 - g.al) * c.curve, abs(g.al * g.close + (1 - g.al) * c.curve - c.curve) from c join g on c.symbol = g.symbol and g.i = c.i + 1),
e as (select symbol, i, slope, 2 / 201.0::double * slope as mean from c where i = 1 union all select c.symbol, c.i, c.slope, 2 / 201.0::double * c.slope + 199 / 201.0::double * e.mean from e join c on c.symbol = e.symbol and c.i = e.i + 1),
r as (select k.symbol, k.bar_ts, k.n < 10 or k.tr > k.atr10 as volatile, coalesce(100 * abs(s.ps - s.ms) / nullif(s.ps + s.ms, 0), 0) > 20 as trending, e.mean > 0 and (e.slope - e.mean) / e.mean >= -0.1 as sloped from k join s using (symbol, i) join e using (symbol, i))
select *, volatile and trending and sloped as passed from r""")
def entry_filters(b):
    return recurrences.filters(b)
