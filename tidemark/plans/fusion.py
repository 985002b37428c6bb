"""Queries of fusion and decisions. Components are squashed: momentum over one and five bars, and the turned z-score of ten."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import decisions as D
from tidemark.operators import fusion as U
from tidemark.operators import signals
from tidemark.plans.registry import W, r6, registered, rounded

_w = f"({W} rows between 9 preceding and current row)"
_sq = lambda x: f"({x}) / (1 + abs({x}))"
ROWS = f", g as (select *, close / nullif(lag(close) over ({W}), 0) - 1 as m1, close / nullif(lag(close, 5) over ({W}), 0) - 1 as m5, (avg(close) over {_w} - close) / nullif(stddev_samp(close) over {_w}, 0) as z, row_number() over ({W}) - 1 as i from b), q as (select symbol, bar_ts, close, volume, i, m1, m5, z, round({_sq('m5')}, 9) as s_ldc, round({_sq('z')}, 9) as s_mr, round({_sq('m1')}, 9) as s_tsmom from g), k as (select * from q where s_ldc is not null and s_mr is not null and s_tsmom is not null)"


def rows(b):
    w = B.last(10)
    m = lambda n: F.col("close") / F.nullif(B.back("close", n), F.lit(0.0)) - 1
    d = b.select("symbol", "bar_ts", "close", "volume", (F.row_number().over(B.by_symbol()) - 1).alias("i"), m(1).alias("m1"), m(5).alias("m5"), ((F.avg("close").over(w) - F.col("close")) / F.nullif(F.stddev_samp("close").over(w), F.lit(0.0))).alias("z"))
    return d.select("*", *rounded(9, -0.0, **{n: F.col(c) / (1 + F.abs(c)) for n, c in (("s_ldc", "m5"), ("s_mr", "z"), ("s_tsmom", "m1"))}))


def known(b):
    return rows(b).where("s_ldc is not null and s_mr is not null and s_tsmom is not null")


def cols(*names):
    return [F.col(c) for c in names]


SIGNAL = ROWS + ", t as (select *, case when m1 > 0 then 'BUY' when m1 < -0.5 then 'SELL' else 'HOLD' end as side, m1 as strength, 1 / (volume - 1)::double as confidence, case when volume > 3 then 'sym ' || symbol else 'SYM' || symbol end as name, volume * 1000 - 500 as age from k), x as (select *, [s_ldc, s_mr * s_mr, 1 - s_ldc - s_mr * s_mr] as probs from t)"
_rules = [("components", "true"), ("symbol", "length(name) between 3 and 20 and regexp_full_match(name, '[A-Z0-9]+')"), ("age", "age <= 3600 and -age <= 300"), ("confidence", "volume > 1 and confidence between 0 and 1"), ("strength", "abs(strength) <= 1"), ("consistency", "case side when 'BUY' then strength > 0 when 'SELL' then strength < 0 else true end"), ("probabilities", "list_min(probs) >= 0 and list_max(probs) <= 1")]


@registered(SIGNAL + f", f as (select symbol, unnest(list_filter([{', '.join(f"case when not coalesce({x}, false) then '{n}' end" for n, x in _rules)}], lambda r: r is not null)) as rule from x) select symbol, rule, count(*) as n from f group by all")
def signal_rules(b):
    """Signals made to break rules: too strong, too old, of odd names, at odds with their side."""
    d = known(b).withColumns({"strength": F.col("m1"), "side": F.when(F.col("m1") > 0, "BUY").when(F.col("m1") < -0.5, "SELL").otherwise("HOLD"), "confidence": F.expr("try_divide(1D, volume - 1)"), "now": F.col("volume") * 1000 - 500, "at": F.lit(0)})
    d = d.withColumns({"probs": F.array(F.col("s_ldc"), F.col("s_mr") * F.col("s_mr"), 1 - F.col("s_ldc") - F.col("s_mr") * F.col("s_mr")), "key": F.col("symbol"), "symbol": F.when(F.col("volume") > 3, F.concat(F.lit("sym "), "symbol")).otherwise(F.concat(F.lit("SYM"), "symbol"))})
    return d.select(F.col("key").alias("symbol"), F.explode(U.faults([n for n, _ in _rules])).alias("rule")).groupBy("symbol", "rule").agg(F.count("*").alias("n"))


FUSED = ROWS + ", f as (select *, (s_ldc * 0.5 + s_mr * 0.3 + s_tsmom * 0.2)::double as score from k), d as (select *, case when score >= 0.3 and (s_ldc > 0.5 or s_mr > 0.5 or s_tsmom > 0.5) then 'BUY' when score <= -0.3 and (s_ldc < -0.5 or s_mr < -0.5 or s_tsmom < -0.5) then 'SELL' else 'HOLD' end as side from f), h as (select *, case when side = 'HOLD' then 0 else least(abs(score), 1) end as strength, case when abs(s_ldc * 0.5) >= greatest(abs(s_mr * 0.3), abs(s_tsmom * 0.2)) then 's_ldc' when abs(s_mr * 0.3) >= abs(s_tsmom * 0.2) then 's_mr' else 's_tsmom' end as source, greatest(abs(s_ldc * 0.5), abs(s_mr * 0.3), abs(s_tsmom * 0.2)) / (abs(s_ldc * 0.5) + abs(s_mr * 0.3) + abs(s_tsmom * 0.2)) as top_share from d)"
_weights = {"s_ldc": 0.5, "s_mr": 0.3, "s_tsmom": 0.2}


def fused(b):
    s, w = cols(*_weights), [F.lit(x) for x in _weights.values()]
    d = known(b).withColumn("score", U.fused(s, w))
    side, strength = U.decision(F.col("score"), s)
    parts = [F.abs(x * y) for x, y in zip(s, w)]
    return d.withColumns({"side": side, "strength": strength, "source": U.dominant(dict(zip(_weights, s)), dict(zip(_weights, w))), "top_share": F.greatest(*parts) / sum(parts[1:], parts[0])})


@registered(FUSED + " select symbol, bar_ts, round(score, 6) as score, side, round(strength, 6) as strength, source, round(top_share, 6) as top_share from h where abs(s_ldc) + abs(s_mr) + abs(s_tsmom) > 0")
def fused_decisions(b):
    return fused(b.where("true")).where("abs(s_ldc) + abs(s_mr) + abs(s_tsmom) > 0").select("symbol", "bar_ts", *r6(score="score"), "side", *r6(strength="strength"), "source", *r6(top_share="top_share"))


@registered(ROWS + ", o as (select symbol, bar_ts, i, case when m1 is not null then m1 / (1 + abs(m1)) else 0 end as v1, case when m1 is not null then 'ready' when i < 6 then 'warmup' else 'missing' end as t1, case when m5 is not null and i >= 8 then least(greatest(sign(m5) * 5 / 8, -1), 1) else 0 end as v2, case when m5 is not null and i >= 8 then 'ready' when i < 6 then 'warmup' else 'missing' end as t2 from q) select symbol, bar_ts, round(v1, 6) as momentum, t1 as momentum_status, round(v2, 6) as vote, t2 as vote_status, case when t1 = 'ready' and t2 = 'ready' then 'use' when i < 6 then 'skip' else 'error' end as policy from o")
def observations(b):
    d = rows(b).withColumns({"a": U.observation(F.col("m1"), F.col("i"), 6), "v": U.vote_observation(F.signum("m5") * 5, 8, F.col("i"), F.col("i"), 6)})
    return d.select("symbol", "bar_ts", *r6(momentum="a.value", vote="v.value"), F.col("a.status").alias("momentum_status"), F.col("v.status").alias("vote_status"), U.row_policy(F.col("i"), 6, cols("a.status", "v.status"), skip=False).alias("policy"))


_table = [{"s_ldc": 0.6, "s_mr": 0.2, "s_tsmom": 0.2}, {"s_ldc": 0.1, "s_mr": 0.8, "s_tsmom": 0.1}]


@registered(ROWS + ", p as (select symbol, bar_ts, (s_mr + 1) / 2 as p0, case when volume > 4 then 0.9 else 1 - (s_mr + 1) / 2 end as p1 from k), v as (select *, p0 <= 1 and p1 <= 1 and abs(p0 + p1 - 1) <= 0.01 as fine, p0 * 0.6 + p1 * 0.1 as a, p0 * 0.2 + p1 * 0.8 as c, p0 * 0.2 + p1 * 0.1 as d from p) select symbol, bar_ts, round(case when fine then a / (a + c + d) else 1 / 3.0::double end, 6) as s_ldc, round(case when fine then c / (a + c + d) else 1 / 3.0::double end, 6) as s_mr, round(case when fine then d / (a + c + d) else 1 / 3.0::double end, 6) as s_tsmom from v")
def blended_weights(b):
    p0 = (F.col("s_mr") + 1) / 2
    d = known(b).withColumn("probs", F.array(p0, F.when(F.col("volume") > 4, 0.9).otherwise(1 - p0)))
    return d.select("symbol", "bar_ts", *r6(**U.blended(F.col("probs"), _table)))


@registered(ROWS + ", p as (select symbol, bar_ts, case when volume = 1 then 'x' else cast(volume - 2 as varchar) end as state from k) select symbol, bar_ts, state, case state when '0' then 0.6 when '1' then 0.1 else round(1 / 3.0::double, 6) end as s_ldc, case state when '0' then 0.2 when '1' then 0.8 else round(1 / 3.0::double, 6) end as s_mr from p")
def regime_weights(b):
    d = known(b).withColumn("state", F.when(F.col("volume") == 1, "x").otherwise((F.col("volume") - 2).cast("string")))
    w = U.state_weights(F.col("state"), dict(enumerate(_table)))
    return d.select("symbol", "bar_ts", "state", *r6(s_ldc=w["s_ldc"], s_mr=w["s_mr"]))


@registered(FUSED + ", n as (select symbol, date_trunc('week', bar_ts) as bar_ts, side, strength, epoch(h.bar_ts)::bigint as source from h), r as (select *, row_number() over (partition by symbol, bar_ts order by (side <> 'HOLD') desc, case when side <> 'HOLD' then strength else 0 end desc, source) as o from n) select symbol, cast(bar_ts as timestamp) as bar_ts, side, round(strength, 6) as strength, source from r where o = 1")
def resolved_signals(b):
    """The strongest signal of a symbol's week."""
    d = fused(b).select("symbol", F.date_trunc("week", "bar_ts").alias("week"), "side", "strength", F.unix_timestamp("bar_ts").alias("source"))
    return U.resolved(d.withColumnRenamed("week", "bar_ts")).select("symbol", "bar_ts", "side", *r6(strength="strength"), "source")


@registered(FUSED + " select symbol, bar_ts, printf('%.3f|%.3f|%.3f', s_ldc * 0.99917, s_mr * 0.99917, s_tsmom * 0.99917) as key, round(s_mr * 1000)::int as k, printf('%s %s strength=%.3f confidence=%.3f', symbol, side, strength, abs(s_mr)) as line, case when volume > 3 then null else side end as parsed, substr(sha256(symbol || '|' || side || '|' || epoch(bar_ts)::bigint::varchar), 1, 16) as checksum, side as json_side, round(s_mr, 6) as json_mr from h")
def signal_texts(b):
    """Keys, lines, checksums, sides read from text in any case, and a round trip through JSON."""
    d = fused(b).withColumn("probs", F.array(F.lit(0.5), F.lit(0.5))).withColumn("components", F.struct("s_ldc", "s_mr", "s_tsmom")).withColumn("confidence", F.abs("s_mr"))
    d = d.withColumn("json", U.from_json(U.to_json(F.struct("symbol", "side", "strength", "confidence", "components", "probs"))))
    text = F.when(F.col("volume") > 3, "nothing").otherwise(F.concat(F.lit(" "), F.lower("side")))
    return d.select("symbol", "bar_ts", U.cache_key([x * 0.99917 for x in cols("s_ldc", "s_mr", "s_tsmom")]).alias("key"), U.rounded_key(F.col("s_mr")).alias("k"), U.compact(F.col("symbol"), F.col("side"), F.col("strength"), F.col("confidence")).alias("line"), U.side_of(text).alias("parsed"), U.checksum(F.col("symbol"), F.col("side"), F.unix_timestamp("bar_ts")).alias("checksum"), F.col("json.side").alias("json_side"), *rounded(6, -0.0, json_mr="json.components.s_mr"))


_lim = D.Limits()
DECIDE = FUSED + f""", e as (select symbol, epoch(bar_ts) as t, bar_ts, side, strength, top_share, row_number() over ({W}) as i from h),
s as (select symbol, 0::bigint as i, 'flat' as pos, null::double as last, null::double as dy, 0 as taken, null::varchar as ls, 0 as run, []::varchar[] as hist, null::varchar as act, null::varchar as why, 0.0::double as conf from (select distinct symbol from e)
union all select symbol, i, case when act in ('BUY', 'ADD_LONG') then 'long' when act in ('SELL', 'ADD_SHORT') then 'short' when act = 'HOLD' then pos else 'flat' end, case when act = 'HOLD' then last else t end, case when act = 'HOLD' then dy else floor(t / 86400) end, case when act = 'HOLD' then taken when dy = floor(t / 86400) then taken + 1 else 1 end, case when act = 'HOLD' then ls else side end, case when act = 'HOLD' then run when ls = side then run + 1 else 1 end, case when side = 'HOLD' then hist else list_append(hist, side)[-3:] end, act, why,
 case when act = 'HOLD' then 0 else least(1, strength * (case when len(hist) < 3 then 1 when len(list_filter(hist, lambda x: x = side)) = 3 then 1.1 when not list_contains(hist, side) then 0.9 else 1 end) * (1 + 0.2 * greatest(0, top_share - 1 / 3.0::double) * 1.5)) end from (
 select *, case when side = 'HOLD' or why is not null then 'HOLD' when pos = 'flat' then side when (pos = 'long') = (side = 'BUY') then case when strength > {_lim.add} then case pos when 'long' then 'ADD_LONG' else 'ADD_SHORT' end else 'HOLD' end when pos = 'long' then 'CLOSE_LONG' else 'CLOSE_SHORT' end as act from (
  select s.symbol, e.i, e.t, e.side, e.strength, e.top_share, s.pos, s.last, s.dy, s.taken, s.ls, s.run, s.hist, case when e.side = 'HOLD' then null when s.dy = floor(e.t / 86400) and s.taken >= {_lim.daily} then 'daily' when e.t - s.last < {_lim.cooldown} then 'cooldown' when s.ls = e.side and s.run >= {_lim.consecutive} then 'consecutive' when e.strength < (case s.pos when 'flat' then {_lim.least} else {_lim.least_held} end) then 'strength' end as why from s join e on s.symbol = e.symbol and e.i = s.i + 1)))"""


@registered(DECIDE + " select e.symbol, e.bar_ts, e.side, s.act as action, s.why as blocked, round(s.conf, 6) as confidence from s join e using (symbol, i)")
def trade_decisions(b):
    return D.decisions(fused(b)).select("symbol", "bar_ts", "side", "action", "blocked", *r6(confidence="confidence"))


@registered(FUSED + f""", e as (select symbol, bar_ts, epoch(bar_ts) as t, side, row_number() over ({W}) as i from h),
s as (select symbol, 0::bigint as i, null::double as last, false as emit from (select distinct symbol from e) union all select s.symbol, e.i, case when e.side <> 'HOLD' and (s.last is null or e.t - s.last >= 259200) then e.t else s.last end, e.side <> 'HOLD' and (s.last is null or e.t - s.last >= 259200) from s join e on s.symbol = e.symbol and e.i = s.i + 1)
select e.symbol, e.bar_ts, e.side, s.emit from s join e using (symbol, i)""")
def emitted_signals(b):
    """Signals that leave after a cooldown of three days since the last that left."""
    return signals.cooled(fused(b), 3 * 86_400)


PORTFOLIO = FUSED + """, d0 as (select distinct bar_ts from h), tt as (select bar_ts, row_number() over (order by bar_ts) as ti from d0),
e as (select substr(symbol, 1, 1) as run_id, symbol, h.bar_ts, close, side, row_number() over (partition by substr(symbol, 1, 1) order by h.bar_ts, symbol) as i from h),
s as (select run_id, 0::bigint as i, 100000.0::double as cash, map([]::varchar[], []::double[]) as q, map([]::varchar[], []::double[]) as en, 0.0::double as realised from (select distinct run_id from e)
union all select run_id, i, case when trade = 0 then cash else cash - trade * close - 0.001 * abs(trade) * close end, case when trade = 0 then q when have <> 0 then map_from_entries(list_filter(map_entries(q), lambda x: x.key <> symbol)) else map_concat(q, map([symbol], [trade])) end, case when trade <> 0 and have = 0 then map_concat(en, map([symbol], [close])) else en end, case when trade <> 0 and have <> 0 then realised + have * (close - en[symbol]) else realised end from (
 select *, case when (side = 'BUY' and have <= 0) or (side = 'SELL' and have >= 0) then case when have <> 0 then -have when cash >= 2000 then (case side when 'BUY' then 1 else -1 end) * 2000 / close else 0 end else 0 end as trade from (
  select s.run_id, e.i, e.symbol, e.close, e.side, s.cash, s.q, s.en, s.realised, coalesce(s.q[e.symbol], 0) as have from s join e on s.run_id = e.run_id and e.i = s.i + 1))),
z as (select e.run_id, e.bar_ts, max(e.i) as i from e group by all), y as (select z.run_id, z.bar_ts, s.cash, s.realised, unnest(case when cardinality(s.q) = 0 then [null] else map_entries(s.q) end) as x, s.en from z join s on z.run_id = s.run_id and z.i = s.i),
px as (select run_id, bar_ts, cash, realised, x.key as symbol, x.value as q, en[x.key] as entry from y), pr as (select px.*, h.close from px asof left join h on px.symbol = h.symbol and px.bar_ts >= h.bar_ts)"""


@registered(PORTFOLIO + " select run_id, bar_ts, round(any_value(cash), 4) as cash, round(any_value(cash) + coalesce(sum(q * close), 0), 4) as value, round(coalesce(sum(abs(q) * close), 0), 4) as exposure, round(coalesce(sum(q * (close - entry)), 0), 4) as unrealised, round(any_value(realised), 4) as realised, count(symbol)::int as n_positions from pr group by run_id, bar_ts")
def shared_portfolios(b):
    """Accounts that each trade the symbols of a first digit with shared cash."""
    d = fused(b).withColumn("run_id", F.substring("symbol", 1, 1))
    return D.shared_cash(d).select("run_id", "bar_ts", *rounded(4, **{c: c for c in ("cash", "value", "exposure", "unrealised", "realised")}), "n_positions")
