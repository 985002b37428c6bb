"""Folds, sources, sinks, models and streams on small fixtures."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions, hmm, models, preprocess, quality, recurrences, search, signals, trades, validation
from tidemark.operators import features as feats
from tidemark.operators.bars import bars_from_ticks
from tidemark.sources import generators, market, records, sinks, storage
from tidemark.streaming.bars import stream_bars
from tidemark.streaming.stateful import stream_cooled, stream_states

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return [T0 + dt.timedelta(hours=k) for k in range(n)]


def test_partitions_stay_when_others_are_written(spark, tmp_path):
    rows = generators.ohlcv(spark, 600, 2, start=1_704_067_200, step=600)
    bars = market.timed(rows)
    for day in (1, 2, 3):
        market.write_partitioned(bars.where(F.day("bar_ts") == day), str(tmp_path), "10m")
    back = market.read_partitioned(spark, str(tmp_path), symbols=["1"], first="2024-01-02", last="2024-01-03", interval="10m")
    assert back.count() == bars.where("symbol = '1' and day(bar_ts) in (2, 3)").count() > 0
    assert "PartitionFilters: [" in (plan := back._jdf.queryExecution().toString()) and "symbol" in plan
    assert market.is_partitioned(spark, f"{tmp_path}/ohlcv") and not market.is_partitioned(spark, str(tmp_path))


def test_flat_layout_combination_and_selection(spark, tmp_path):
    bars = market.timed(generators.ohlcv(spark, 50, 2))
    bars.write.parquet(f"{tmp_path}/x/a_ohlcv_1.parquet")
    s = bars.where("symbol = '1'").select("symbol", "bar_ts", F.lit(0.5).alias("s_mr"))
    s.write.parquet(f"{tmp_path}/x/a_signals_1.parquet")
    assert market.load_kind(spark, f"{tmp_path}/x", "ohlcv", ["1"]).count() == 50
    flat = market.read_flat(spark, f"{tmp_path}/x", "ohlcv")
    assert market.selected(flat, ["close", "nothing"]).columns == ["symbol", "bar_ts", "close"]
    assert market.selected(flat).columns == ["symbol", "bar_ts", "open", "high", "low", "close", "volume"]
    a, b = market.aligned(s, bars)
    assert a.count() == b.count() == 50


def test_pipeline_of_sound_and_unsound_bars(spark, tmp_path):
    bars = market.timed(generators.ohlcv(spark, 60, 1, step=3600))
    paths = market.process_and_save(bars, str(tmp_path), "1h")
    assert [spark.read.parquet(p).count() for p in paths] == [60, 60, 60]
    with pytest.raises(ValueError, match="volume"):
        market.process_and_save(bars.withColumn("volume", F.lit(-1.0)), str(tmp_path), "1h")
    with pytest.raises(ValueError):
        market.not_empty(market.between(bars, dt.datetime(1990, 1, 1), dt.datetime(1990, 1, 2)))
    with pytest.raises(Exception, match="close is null"):
        market.typed(generators.ohlcv(spark, 3).withColumn("close", F.lit(None).cast("double"))).collect()


def test_faulty_rows_break_what_they_say(spark):
    d = market.timed(generators.faulty(spark)).withColumn("found", market.faults())
    assert all(set(r.breaks) <= set(r.found) and bool(r.breaks) == bool(r.found) for r in d.collect())
    assert quality.broken(market.timed(generators.edge_cases(spark))).where("rule not in ('none', 'bracket')").count() == 0


def test_generated_bars_are_sound_and_repeatable(spark, tmp_path):
    a, b = (generators.ohlcv(spark, 300, 3).orderBy("symbol", "timestamp").collect() for _ in range(2))
    assert a == b and quality.broken(market.timed(generators.ohlcv(spark, 300, 3))).select("rule").distinct().collect() == [("none",)]
    assert {spark.read.parquet(p).count() for p in generators.suite(spark, str(tmp_path)).values()} == {1000, 10, 6, 300}


def test_records_verify_and_tampering_is_seen(spark, tmp_path):
    bars = market.timed(generators.ohlcv(spark, 40))
    rows = bars.withColumns({"s_ldc": F.lit(0.1), "s_mr": F.lit(0.2), "s_tsmom": F.lit(None).cast("double"), "score": F.lit(float("nan")), "side": F.lit("HOLD")})
    path = f"{tmp_path}/run"
    summary = records.write_run(records.records(rows), path)
    back = records.read_run(spark, path)
    assert summary["row_count"] == back.count() == 40 and back.where("fused.score is not null").count() == 0
    s, b = records.frames(back, "0")
    assert s.count() == b.count() == 40
    with pytest.raises(ValueError, match="rows|files"):
        records.records(rows.limit(3)).write.mode("append").json(path)
        records.read_run(spark, path)


def test_storage(spark, tmp_path):
    store = storage.Artifacts(spark, f"file://{tmp_path}/models")
    for v in ("1.2.0", "1.10.0", "1.9.3"):
        store.put("a", v, {"tags": ["x", "y"], "metrics": {"bic": float(v.split(".")[1])}, "ready": v == "1.10.0"})
    store.put("b", "0.1", {"tags": ["x"], "metrics": {"bic": 1.0, "aic": 2.0}, "ready": False})
    assert store.versions("a") == ["1.2.0", "1.9.3", "1.10.0"] and store.get("a")["ready"]
    assert [e["experiment"] for e in store.experiments(tags=["x"])] == ["a", "b"] and [e["experiment"] for e in store.experiments(ready=True)] == ["a"]
    assert store.compared(["a", "b"]) == {"aic": {"a": None, "b": 2.0}, "bic": {"a": 10.0, "b": 1.0}}
    storage.write_text(spark, f"file://{tmp_path}/t.json", "one")
    storage.write_text(spark, f"file://{tmp_path}/t.json", "two")
    assert storage.read_text(spark, f"file://{tmp_path}/t.json") == "two"
    spark.range(3).write.parquet(f"{tmp_path}/new")
    storage.replace_folder(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/old")
    assert spark.read.parquet(f"{tmp_path}/old").count() == 3 and not storage.exists(spark, f"file://{tmp_path}/new")


def test_sinks(spark):
    b = sinks.Backoff(0.1, 1.0, 0.25)
    assert [round(b.delay(k, 0.5), 3) for k in (1, 2, 5, 9)] == [0.1, 0.2, 1.0, 1.0] and b.delay(1, 0.0) == pytest.approx(0.075)
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert b.call(flaky, lambda s: None) == "done" and len(tries) == 3
    br = sinks.Breaker(2, 1, 10)
    br.failed(0), br.failed(1)
    assert not br.allowed(5) and br.allowed(12) and br.state == "half open"
    br.succeeded()
    assert br.state == "closed"
    for how, want in (("drop_oldest", [2, 3]), ("drop_newest", [1, 2]), ("drop_lowest", [1, 3])):
        q = sinks.Buffer(2, how)
        for i, c in ((1, 0.5), (2, 0.1), (3, 0.9)):
            q.push({"id": i, "confidence": c, "priority": -i})
        assert [x["id"] for x in q.held] == want and sinks.Buffer.loads(q.dumps()) == q
    assert q.pop_highest()["id"] == 1 and q.pop()["id"] == 3 and q.pop() is None
    with pytest.raises(OverflowError):
        sinks.Buffer(0, "error").push({})
    c = sinks.Cache(2, 10)
    c.put(c.key([0.1234, 1, 2]), "w", 0)
    assert c.get(c.key([0.1231, 1, 2]), 5) == "w" and c.get(c.key([0.1231, 1, 2]), 11) is None
    c.put("old", 1, 0)
    assert c.expire(20) == 1
    fine, static = {"w_ldc": 1.0}, {"w_ldc": 0.5}
    cache = sinks.Cache()
    assert sinks.resolve([1, 2, 3], 0, cache, lambda o: fine, static) == (fine, "model") and sinks.resolve([1, 2, 3], 1, cache, None, None) == (fine, "cache")
    broken = lambda o: 1 / 0
    assert sinks.resolve([4, 2, 3], 0, sinks.Cache(), broken, static) == (static, "static") and sinks.resolve([4, 2, 3], 0, sinks.Cache(), broken, None)[1] == "equal"
    assert sinks.resolve([4, 2, 3], 0, sinks.Cache(), broken, static, fine) == (fine, "previous")
    with pytest.raises(ZeroDivisionError):
        sinks.resolve([4, 2, 3], 0, sinks.Cache(), broken, static, fail=True)
    got = []
    out = sinks.published(spark.range(2), {"a": lambda d: got.extend(d.collect()), "b": lambda d: 1 / 0})
    assert len(got) == 2 and out["a"] == "ok" and out["b"].startswith("ZeroDivision")


def test_redis_fields(spark, tmp_path):
    path = f"{tmp_path}/log"

    class Client:
        def xadd(self, stream, fields, maxlen, approximate):
            with open(path, "a") as f:
                f.write(f"{stream} {sorted(fields)} {maxlen}\n")

    sinks.to_redis(spark.createDataFrame([("x", (1.0, [0.5]))], "symbol string, c struct<a: double, p: array<double>>"), Client)
    assert open(path).read() == "signals:x ['c_a', 'c_p', 'symbol'] 10000\n"


def test_models(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(5, 0.5, 60)])
    d = spark.createDataFrame(pd.DataFrame({"symbol": "x", "bar_ts": hours(120), "x": x}))
    m, _ = hmm.fit(d, ["x"], 2, 10)
    assert not models.faults(m) and models.fingerprint(models.of_document(models.document(m))) == models.fingerprint(m)
    with pytest.raises(ValueError, match="moves"):
        models.of_document({**models.document(m), "move": [[0.5, 0.4], [0.5, 0.5]]})
    got = models.evaluate(d, m, ["x"])
    assert got["log_likelihood"] == pytest.approx(hmm.forward(m, x[:, None])[2]) and got["n_params"] == 7 and got["bic"] > got["aic"]
    g = np.array([r.probs for r in models.posteriors(d, m, ["x"]).orderBy("bar_ts").collect()])
    assert np.allclose(g.sum(axis=1), 1) and np.allclose(g.sum(axis=0), hmm.expected(m, x[:, None])[3])
    train, test = models.split(d)
    assert train.count() == 96 and test.count() == 24 and validation.separated(train, test) and not validation.separated(test, train)
    assert models.enough(d, ["x"], 2) == [] and models.enough(d.limit(2), ["x"], 2) == ["rows"]
    p = models.Prepared.of(np.zeros((1, 2)), np.array([[[2.0, 0.3], [0.3, 1.0]]]), 0)
    c = np.array([[2.0, 0.3], [0.3, 1.0]])
    v = np.array([0.5, -1.0])
    assert p.log_density(v[None])[0, 0] == pytest.approx(-0.5 * (v @ np.linalg.inv(c) @ v + np.log(np.linalg.det(c)) + 2 * np.log(2 * np.pi)))
    assert models.performance_weights([1.0, 3.0, 1.0]) == [0, 1, 0] and models.diversity_weights(np.array([[0, 1.0], [1.0, 0]])) == [0.5, 0.5]
    assert [r["states"] for r in models.searched(d, ["x"], [1, 2], 6)] == [2, 1]
    assert models.sensitivity(lambda a, b: a * b, "a", [1, 3], b=2)[1] == {"parameter": "a", "value": 3, "score": 6.0, "spread": 4.0}


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.1]])
    d = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    c = preprocess.principal(d, list("abc"), 2)
    got = preprocess.projected(d, list("abc"), c).toPandas()[["pc_1", "pc_2"]].to_numpy()
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2]), atol=1e-8) and c.share[0] > c.share[1]


def test_scan_against_a_plain_loop():
    rng = np.random.default_rng(4)
    d, label = rng.random(60), rng.integers(-1, 2, 60)
    got = search.scanned(d, label, 3, 4)
    bound, held = -1.0, []
    for i in range(60):
        if i % 4 == 0 and d[i] >= bound:
            bound = d[i]
            held.append(i)
            if len(held) > 3:
                del held[0]
    assert got[0] == sorted(d[held]) and set(got[1]) <= {-1, 0, 1}


def test_bucketed_neighbours_find_most(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 3))
    v = spark.createDataFrame(pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query")
    got = search.bucketed(v, q, ["a", "b", "c"], 8, width=1.5, tables=6).toPandas()
    d = search.distances(x[::10], x)
    hit = sum(len(set(np.lexsort((np.arange(300), r))[:8]) & set(got.id[got["query"] == k * 10])) for k, r in enumerate(d))
    assert hit >= 0.9 * 240


def test_long_series_in_blocks_votes_the_same(spark):
    rng = np.random.default_rng(6)
    n = 300
    d = spark.createDataFrame(pd.DataFrame({"symbol": "x", "bar_ts": hours(n), "a": rng.normal(size=n), "label": rng.integers(-1, 2, n)}))
    one, many = ({r.bar_ts: (r.vote, r.n, round(r.confidence, 9)) for r in search.predict(d, ["a"], back=64, block=b).collect()} for b in (10_000, 20))
    assert one == many and len(one) > 280


def test_adx_against_the_formula():
    rng = np.random.default_rng(7)
    c = 50 + rng.normal(size=40).cumsum()
    h, lo = c + rng.random(40), c - rng.random(40)
    got = recurrences.adx(h, lo, c, 5)
    s, dx, out = [0.0, 0.0, 0.0], [], None
    for t in range(40):
        up, down = (h[t] - h[t - 1], lo[t - 1] - lo[t]) if t else (0.0, 0.0)
        tr = h[t] - lo[t] if not t else max(h[t] - lo[t], abs(h[t] - c[t - 1]), abs(lo[t] - c[t - 1]))
        new = [tr, up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0]
        s = new if not t else [0.8 * a + 0.2 * b for a, b in zip(s, new)]
        p, m = 100 * s[1] / s[0], 100 * s[2] / s[0]
        dx.append(100 * abs(p - m) / (p + m) if t >= 4 and p + m > 1e-10 else 0.0)
        out = dx[-1] if out is None else 0.8 * out + 0.2 * dx[-1]
        assert np.isnan(got[t]) if t < 4 else got[t] == pytest.approx(out)


def test_portfolio_accounts():
    p = decisions.Portfolio(1000.0)
    p.trade("x", 10, 10.0)
    p.trade("x", 10, 20.0)
    p.trade("x", -5, 30.0)
    assert p.held["x"] == [15, 15.0] and p.realised == 75 and p.snapshot()[0] == 850 + 450
    p.trade("x", -20, 30.0, 1.0)
    assert p.held["x"] == [-5, 30.0] and p.realised == 75 + 225 and p.paid == 1.0 and p.faults() == []
    wrong = decisions.Portfolio(1000.0, wrong_partial=True)
    wrong.trade("x", 10, 10.0)
    wrong.trade("x", -5, 30.0)
    assert wrong.realised == -100 and wrong.held["x"] == [5, 30.0]


def test_exits_in_order():
    p = trades.Plan()
    assert trades.exit_reason(1, 100, 94, 1, 0.9, p) == "StopLoss" and trades.exit_reason(-1, 100, 89, 1, 0.9, p) == "TakeProfit"
    assert trades.exit_reason(1, 100, 101, 500, 0, p) == "MaxHoldingPeriod" and trades.exit_reason(1, 100, 101, 30, -0.6, p) == "OppositeSignal"
    assert trades.exit_reason(1, 100, 101, 3, -0.9, p) is None
    assert trades.realised(1, 100, 2, 110, trades.Plan(cost=0, slippage=0)) == 20 and trades.unrealised(-1, 100, 2, 110) == -20


def test_periods_and_windows(spark):
    assert validation.period("6M").days == 180 and validation.period("2w").days == 14
    with pytest.raises(ValueError):
        validation.period("x")
    w = validation.windows(spark, T0, T0 + dt.timedelta(days=20), "10D", "5D", "5D").collect()
    assert len(w) == 2 and all(a.train_end == a.test_start for a in w)


def _stream(spark, tmp_path, df, f, schema=None):
    """f of a stream of df in several files of time order, and the batch's rows."""
    n = df.count()
    rows = df.orderBy("bar_ts").collect()
    for k in range(4):
        spark.createDataFrame(rows[k * n // 4 : (k + 1) * n // 4], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = f(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_of_cooled_signals_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    d = spark.createDataFrame(pd.DataFrame({"symbol": rng.choice(["a", "b"], 80), "bar_ts": hours(80), "side": rng.choice(["BUY", "SELL", "HOLD"], 80)}), "symbol string, bar_ts timestamp, side string")
    got = _stream(spark, tmp_path, d, lambda s: stream_cooled(s, 5 * 3600))
    assert sorted(map(tuple, got)) == sorted(map(tuple, signals.cooled(d, 5 * 3600).collect()))


def test_stream_of_states_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.0], [1.0]]), np.array([[0.5], [0.3]]))
    d = spark.createDataFrame(pd.DataFrame({"symbol": rng.choice(["a", "b"], 60), "bar_ts": hours(60), "x": rng.normal(size=60)}), "symbol string, bar_ts timestamp, x double")
    got = {(r.symbol, r.bar_ts): r.probs for r in _stream(spark, tmp_path, d, lambda s: stream_states(s, m, ["x"]))}
    want = {(r.symbol, r.bar_ts): r.probs for r in hmm.infer(d, m, ["x"]).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_stream_of_bars_with_a_closing_tick_equals_batch(spark, tmp_path):
    ticks = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=17 * k), k, float(k % 7)) for k in range(60)], "event_type string, bar_ts timestamp, event_id long, value double")
    closing = spark.createDataFrame([("z", T0 + dt.timedelta(days=9), 99, 1.0)], ticks.schema)
    got = _stream(spark, tmp_path, ticks.unionByName(closing), lambda s: stream_bars(s, ts="bar_ts"))
    want = bars_from_ticks(ticks, ts="bar_ts").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_features_of_a_golden_series(spark):
    close = [10.0, 11.0, 12.0, 11.0, 13.0]
    d = spark.createDataFrame([("x", t, c, c, c, c, 1) for t, c in zip(hours(5), close)], "symbol string, bar_ts timestamp, open double, high double, low double, close double, volume int")
    r = feats.features(d).orderBy("bar_ts").collect()
    assert [round(x.sma_20, 6) for x in r] == [10, 10.5, 11, 11, 11.4] and r[0].std_20 is None and r[0].rsi == 100 and r[0].momentum == 0
    ema = list(itertools.accumulate(close, lambda a, c: a + 2 / 21 * (c - a)))
    assert [round(x.ema_20, 9) for x in r] == [round(e, 9) for e in ema] and all(x.adx is None and x.cci is None for x in r)
