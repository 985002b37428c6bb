"""Gaussian hidden Markov models with diagonal covariances, one chain per symbol."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import spread


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        gap = x[:, None, :] - self.mean[None]
        return -0.5 * (np.log(2 * np.pi * self.var)[None] + gap**2 / self.var[None]).sum(axis=2)


def forward(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(filtered state probabilities, scaled densities, log likelihood)."""
    ld = m.log_density(x)
    top = ld.max(axis=1)
    dens = np.exp(ld - top[:, None])
    out, ll, p = np.empty_like(dens), 0.0, m.start
    for t in range(len(x)):
        a = (p if t == 0 else p @ m.move) * dens[t]
        s = a.sum()
        p = out[t] = a / s
        ll += np.log(s) + top[t]
    return out, dens, ll


def viterbi(m: Model, x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        start, move = np.log(m.start), np.log(m.move)
    ld = m.log_density(x)
    best, came = start + ld[0], np.zeros(ld.shape, int)
    for t in range(1, len(x)):
        way = best[:, None] + move
        came[t] = way.argmax(axis=0)
        best = way.max(axis=0) + ld[t]
    path = np.empty(len(x), int)
    path[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def expected(m: Model, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of one chain that a step of expectation maximisation needs."""
    f, dens, ll = forward(m, x)
    g = f.copy()
    moves = np.zeros_like(m.move)
    for t in range(len(x) - 2, -1, -1):
        ahead = f[t] @ m.move
        ratio = np.divide(g[t + 1], ahead, out=np.zeros_like(ahead), where=ahead > 0)
        pair = f[t][:, None] * m.move * ratio[None]
        moves += pair
        g[t] = pair.sum(axis=1)
    return np.array([ll]), g[0], moves.ravel(), g.sum(axis=0), (g.T @ x).ravel(), (g.T @ x**2).ravel()


def _ordered(d: pd.DataFrame, obs: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    d = d.sort_values("bar_ts").dropna(subset=obs)
    return d, d[obs].to_numpy(float)


def _sums_under(m: Model, obs: list[str]):
    def one(p: pd.DataFrame) -> pd.DataFrame:
        _, x = _ordered(p, obs)
        v = np.concatenate(expected(m, x)) if len(x) else np.zeros(0)
        return pd.DataFrame({"i": np.arange(len(v)), "v": v})

    return one


def fit(rows: DataFrame, obs: list[str], states: int = 3, rounds: int = 100, least_var: float = 1e-9, tolerance: float = 1e-2) -> tuple[Model, list[float]]:
    """Expectation maximisation until a step gains less than tolerance in log likelihood, with a warning if rounds steps
    don't suffice: each chain's expected sums are taken where its rows are; only their total, whose size is
    fixed by states and obs, reaches the driver. Returns the model and the log likelihood before each step."""
    rows = spread(rows.select("symbol", "bar_ts", *obs), "symbol").persist()  # read in every step
    try:
        return _fit(rows, obs, states, rounds, least_var, tolerance)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, obs: list[str], states: int, rounds: int, least_var: float, tolerance: float) -> tuple[Model, list[float]]:
    cuts = rows.approxQuantile(obs, [(k + 0.5) / states for k in range(states)], 0.01)
    var = np.array(rows.agg(*[F.var_pop(c) for c in obs]).first(), float)
    m = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)), np.array(cuts).T.copy(), np.tile(np.maximum(var, least_var), (states, 1)))
    np.fill_diagonal(m.move, 0.9 if states > 1 else 1.0)
    likelihoods, d = [], len(obs)
    for _ in range(rounds):
        sums = rows.groupBy("symbol").applyInPandas(_sums_under(m, obs), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i").v.to_numpy()
        if not len(sums):
            return m, likelihoods
        ll, start, moves, n, s1, s2 = np.split(sums, np.cumsum([1, states, states * states, states, states * d]))
        likelihoods.append(float(ll[0]))
        n = np.maximum(n, 1e-300)[:, None]
        moves = moves.reshape(states, states) + 1e-12
        mean = s1.reshape(states, d) / n
        m = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), mean, np.maximum(s2.reshape(states, d) / n - mean**2, least_var))
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < tolerance:
            return m, likelihoods
    warnings.warn(f"the hidden Markov model did not converge in {rounds} steps", stacklevel=3)
    return m, likelihoods


def infer(rows: DataFrame, m: Model, obs: list[str]) -> DataFrame:
    """(symbol, bar_ts, probs, state): filtered probabilities and the state on the likeliest path."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p, x = _ordered(p, obs)
        if not len(x):
            return pd.DataFrame({"symbol": [], "bar_ts": [], "probs": [], "state": []})
        return pd.DataFrame({"symbol": p.symbol, "bar_ts": p.bar_ts, "probs": list(forward(m, x)[0]), "state": viterbi(m, x)})

    return spread(rows.select("symbol", "bar_ts", *obs), "symbol").groupBy("symbol").applyInPandas(one, "symbol string, bar_ts timestamp, probs array<double>, state int")
