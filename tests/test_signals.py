import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import backtest, hmm, joins, signals, voting
from tidemark.operators.bars import bars_from_ticks
from tidemark.plans.queries import QUERIES
from tidemark.sources import market
from tidemark.streaming.bars import stream_bars

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return [T0 + dt.timedelta(hours=k) for k in range(n)]


def test_vote_against_brute_force(spark):
    rng = np.random.default_rng(1)
    n, back = 90, 24
    d = pd.DataFrame({"symbol": "x", "bar_ts": hours(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "label": rng.integers(-1, 2, n)})
    got = {r.bar_ts: (r.vote, r.n) for r in voting.vote(spark.createDataFrame(d), ["a", "b"], 3, 4, back).collect()}
    want = {}
    for i in range(n):
        near = sorted((round(sum(np.log1p(abs(d[f][i] - d[f][j])) for f in "ab"), 9), j) for j in range(0, n, 4) if i - back <= j <= i - 4)[:3]
        if near:
            want[d.bar_ts[i].to_pydatetime()] = (sum(int(d.label[j]) for _, j in near), len(near))
    assert got == want


def test_cooldown():
    assert signals.emitted([0, 5, 10, 19, 20], ["BUY", "SELL", "BUY", "SELL", "HOLD"], 10) == [True, False, True, False, False]


def test_cash_is_conserved():
    close = np.array([10.0, 12.0, 9.0, 11.0])
    free = backtest.Costs(0, 0, 0)
    out = backtest.folded(close, ["BUY", "HOLD", "SELL", "HOLD"], 1000, 0.5, free)
    assert out["value"].tolist() == [1000, 1100, 950, pytest.approx(950 - 475 / 9 * 2)]
    paid = backtest.folded(close, ["BUY", "HOLD", "HOLD", "HOLD"], 1000, 0.5, backtest.Costs())
    assert paid["value"][0] == pytest.approx(1000 - paid["cost"][0])


def test_viterbi_and_likelihood_against_all_paths():
    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.0], [1.0]]), np.array([[0.5], [0.3]]))
    x = np.array([[0.1], [0.9], [1.2], [-0.3]])
    dens = np.exp(m.log_density(x))
    of = {p: m.start[p[0]] * np.prod([m.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([dens[t, s] for t, s in enumerate(p)]) for p in itertools.product((0, 1), repeat=4)}
    assert tuple(hmm.viterbi(m, x)) == max(of, key=of.get)
    assert hmm.forward(m, x)[2] == pytest.approx(np.log(sum(of.values())))


def test_fitting_never_lowers_the_likelihood(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(5, 0.5, 60)])
    d = pd.DataFrame({"symbol": "x", "bar_ts": hours(120), "x": x})
    m, ll = hmm.fit(spark.createDataFrame(d), ["x"], 2, 5)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(ll))
    assert np.allclose(sorted(m.mean.ravel()), [0, 5], atol=0.5)


def test_fitting_goes_on_until_it_converges(spark):
    rng = np.random.default_rng(5)
    x = np.where(np.repeat(rng.integers(0, 2, 30), 10) == 1, 2.0, 0.0) + rng.normal(size=300)
    d = spark.createDataFrame(pd.DataFrame({"symbol": "x", "bar_ts": hours(300), "x": x}))
    ll = hmm.fit(d, ["x"], 3)[1]
    assert 10 < len(ll) <= 100 and (ll[-1] - ll[-2] < 1e-2 or len(ll) == 100)
    with pytest.warns(UserWarning, match="did not converge"):
        assert len(hmm.fit(d, ["x"], 3, 5)[1]) == 5


def test_query_of_hidden_states_fits_to_the_end(spark, monkeypatch):
    fit, seen = hmm.fit, []

    def kept(*args, **kwargs):
        seen.append(fit(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(hmm, "fit", kept)
    assert QUERIES["hidden_states"](spark, "/root/testdata/sf0.001").count()
    ll = seen[0][1]
    assert len(ll) == 100 or ll[-1] - ll[-2] < 1e-2


def test_as_of_and_alignment(spark):
    a = spark.createDataFrame([("x", h) for h in hours(4)], "symbol string, bar_ts timestamp")
    b = spark.createDataFrame([("x", T0 + dt.timedelta(hours=1), 7.0), ("y", T0, 1.0)], "symbol string, bar_ts timestamp, v double")
    assert [r.v for r in joins.as_of(a, b, "v").orderBy("bar_ts").collect()] == [None, 7.0, 7.0, 7.0]
    left, right = joins.aligned(a, b)
    assert [r.bar_ts for r in left.orderBy("bar_ts").collect()] == hours(2) and right.count() == 1


def test_sources_round_trip_and_rules(spark, tmp_path):
    rows = [("x", 1000, 1.0, 2.0, 0.5, 1.5, 3.0), ("x", 1300, 1.0, 0.5, 2.0, 1.5, -1.0)]
    bars = spark.createDataFrame(rows, market.OHLCV)
    for kind, suffix in (("csv", "csv"), ("json", "json"), ("parquet", "parquet")):
        path = f"{tmp_path}/b.{suffix}"
        market.write(bars, path, kind)
        back = market.read(spark, path).select(*bars.columns)
        assert sorted(map(tuple, back.collect())) == rows
    market.write_partitioned(market.timed(bars), f"{tmp_path}/parts", "5m")
    assert spark.read.parquet(f"{tmp_path}/parts").where("symbol = 'x' and interval = '5m'").count() == 2
    assert [r.f for r in bars.orderBy("timestamp").select(market.faults().alias("f")).collect()] == [[], ["range", "bracket", "volume"]]
    with pytest.raises(ValueError):
        market.require(bars.drop("low"))


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=17 * k), k, float(k % 7)) for k in range(60)], "event_type string, ts timestamp, event_id long, value double")
    closing = spark.createDataFrame([("z", T0 + dt.timedelta(days=9), 99, 1.0)], ticks.schema)
    ticks.unionByName(closing).coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    q = stream_bars(s).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bars_out").collect()}
    want = {tuple(r) for r in bars_from_ticks(ticks).collect()}
    assert got == want
