"""Unit roots, signed ranks and the Bayesian search against plain versions."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest

from tidemark.operators import stationarity, statistics, validation

T0 = dt.datetime(2024, 1, 1)


def plain_adf(y):
    """Regressions by least squares over rows, one per number of lags."""
    n, dy = len(y), np.diff(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(lags, skip):
        t = np.arange(skip, n - 1)
        x = np.column_stack([np.ones(len(t)), y[t], *[dy[t - k] for k in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(x, dy[t], rcond=None)
        rest = ((dy[t] - x @ beta) ** 2).sum()
        se = np.sqrt(rest / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        return len(t) * np.log(rest / len(t)) + 2 * x.shape[1], beta[1] / se

    lags = int(np.argmin([fit(k, most)[0] for k in range(most + 1)]))
    return lags, fit(lags, lags)[1]


def test_unit_roots_equal_regressions_over_rows(spark):
    rng = np.random.default_rng(3)
    step = rng.normal(size=400)
    series = {"walk": 100 + np.cumsum(step), "noise": 5 + step, "short": step[:24] + 2, "under": step[:19], "flat": np.full(60, 7.0)}
    around = [0.0]
    for e in step[:200]:
        around.append(0.6 * around[-1] - 0.2 * (around[-2] if len(around) > 1 else 0) + e)
    series["around"] = np.array(around)
    rows = [(s, T0 + dt.timedelta(hours=i), float(v)) for s, y in series.items() for i, v in enumerate(y)]
    rows += [("walk", T0 - dt.timedelta(hours=1), None), ("walk", T0 - dt.timedelta(hours=2), float("nan")), (None, T0, 1.0)]
    d = spark.createDataFrame(rows, "symbol string, bar_ts timestamp, close double").repartition(4)
    got = {r.symbol: r for r in stationarity.adf(d).collect()}
    assert set(got) == {"walk", "noise", "short", "around"}
    for s, r in got.items():
        lags, t = plain_adf(series[s])
        assert r.lags == lags and r.n == len(series[s]) and r.statistic == pytest.approx(t, rel=1e-6)
    assert got["noise"].stationary and got["around"].stationary and not got["walk"].stationary
    assert stationarity.adf(d.limit(0)).collect() == []


def test_p_of_the_usual_critical_values():
    assert [round(stationarity.p_value(t), 3) for t in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.099]
    assert stationarity.p_value(-20) == 0 and stationarity.p_value(3) == 1


def test_signed_ranks(spark):
    def exact(x):
        rank = np.argsort(np.argsort(np.abs(x))) + 1
        w = min(rank[x > 0].sum(), rank[x < 0].sum())
        sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product((0, 1), repeat=len(x))]
        return w, min(1.0, 2 * np.mean([s <= w for s in sums]))

    few, tied = np.array([0.3, -1.2, 2.5, 4.0, -0.1, 0.9, 1.1, 3.3]), [1, 1, -1, 2, 0, 0, 3]
    rows = [("few", float(v), 0.0) for v in few] + [("tied", float(v), 0.0) for v in tied] + [("none", 1.0, 1.0), ("none", None, 1.0)]
    got = {r.k: r for r in statistics.signed_ranks(spark.createDataFrame(rows, "k string, a double, b double"), "a", "b", ("k",)).collect()}
    w, p = exact(few)
    assert got["few"].exact and got["few"].statistic == w and got["few"].p == pytest.approx(p)
    z = (2 - 7.5) / math.sqrt((5 * 6 * 11 - (27 - 3) / 2) / 24)
    assert not got["tied"].exact and got["tied"].n == 5 and got["tied"].statistic == 2 and got["tied"].p == pytest.approx(math.erfc(-z / math.sqrt(2)), abs=1e-6)
    assert got["none"].n == 0 and got["none"].p == 1


def test_bayesian_search_finds_what_random_points_miss():
    calls = []

    def run(x, k, kind):
        calls.append(x)
        if k == 9:
            raise ValueError("no fit")
        return -((x - 0.7) ** 2) - 0.05 * (k - 4) ** 2 - (kind != "b")

    got = validation.bayesian(run, {"x": (0.0, 1.0), "k": (1, 9), "kind": ["a", "b", "c"]}, calls=40, seed=1)
    assert len(got) == len(calls) == 40 and got[0]["score"] > -0.01 and got[0]["params"]["kind"] == "b"
    assert all(r["error"] == "no fit" for r in got if r["params"]["k"] == 9)
    low = validation.bayesian(lambda x: (x - 0.2) ** 2, {"x": (0.0, 1.0)}, calls=20, higher_is_better=False)
    assert low[0]["score"] < 1e-3 and low[0]["score"] <= low[-1]["score"]
