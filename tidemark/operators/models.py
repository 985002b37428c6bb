"""Hidden Markov models as artifacts: checks, criteria, full covariances, weights by state, and choices among fits."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import hmm
from tidemark.operators.bars import spread
from tidemark.operators.validation import expanding, grid_weights


def n_params(states: int, d: int, kind: str = "diag") -> int:
    """Free numbers of start, moves, means and covariances."""
    cov = {"full": states * d * (d + 1) // 2, "diag": states * d, "spherical": states}[kind]
    return states - 1 + states * (states - 1) + states * d + cov


def criteria(log_likelihood: float, n: int, params: int) -> dict[str, float]:
    """aic, bic and perplexity, all better when lower, and the log likelihood."""
    return {"log_likelihood": log_likelihood, "aic": 2 * params - 2 * log_likelihood, "bic": params * math.log(max(n, 1)) - 2 * log_likelihood, "perplexity": math.exp(min(-log_likelihood / max(n, 1), 700.0)), "n_params": float(params)}


def faults(m: hmm.Model, tolerance: float = 1e-6) -> list[str]:
    """What keeps a model from use."""
    k = len(m.start)
    out = []
    if m.move.shape != (k, k) or m.mean.shape[0] != k or m.var.shape != m.mean.shape:
        return ["shapes"]
    if not all(np.isfinite(x).all() for x in (m.start, m.move, m.mean, m.var)):
        out.append("numbers")
    if abs(m.start.sum() - 1) > tolerance or (m.start < 0).any():
        out.append("start")
    if (np.abs(m.move.sum(axis=1) - 1) > tolerance).any() or (m.move < 0).any():
        out.append("moves")
    if (m.var <= 0).any():
        out.append("variances")
    return out


def enough(rows: DataFrame, obs: list[str], states: int) -> list[str]:
    """What keeps rows from a fit: too few, or numbers that aren't finite."""
    bad = F.lit(False)
    for c in obs:
        bad |= F.isnan(c) | (F.abs(c) == float("inf"))
    got = rows.dropna(subset=obs).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    return ["rows"] * (got.n < states * (len(obs) + 1)) + ["numbers"] * (got.bad > 0)


def document(m: hmm.Model) -> dict:
    return {"start": m.start.tolist(), "move": m.move.tolist(), "mean": m.mean.tolist(), "var": m.var.tolist()}


def of_document(d: dict) -> hmm.Model:
    m = hmm.Model(*(np.array(d[k], float) for k in ("start", "move", "mean", "var")))
    if bad := faults(m):
        raise ValueError(f"unsound model: {', '.join(bad)}")
    return m


def fingerprint(m: hmm.Model) -> str:
    return hashlib.sha256(json.dumps(document(m), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Prepared:
    """A Gaussian of full covariance by state, with inverses and log determinants."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, cov: np.ndarray, ridge: float = 1e-6) -> Prepared:
        low = np.linalg.cholesky(cov + ridge * np.eye(cov.shape[-1]))
        return cls(mean, np.linalg.inv(cov + ridge * np.eye(cov.shape[-1])), 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        gap = x[:, None, :] - self.mean[None]
        return -0.5 * (np.einsum("nkd,kde,nke->nk", gap, self.inverse, gap) + self.log_det[None] + x.shape[1] * math.log(2 * math.pi))


def evaluate(rows: DataFrame, m: hmm.Model, obs: list[str]) -> dict[str, float]:
    """Criteria of a model over all chains; each chain's likelihood is taken where its rows are."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        _, x = hmm._ordered(p, obs)
        return pd.DataFrame({"ll": [hmm.forward(m, x)[2] if len(x) else 0.0], "n": [len(x)]})

    got = rows.select("symbol", "bar_ts", *obs).groupBy("symbol").applyInPandas(one, "ll double, n long").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n")).first()
    return criteria(got.ll or 0.0, got.n or 0, n_params(len(m.start), len(obs)))


def posteriors(rows: DataFrame, m: hmm.Model, obs: list[str]) -> DataFrame:
    """(symbol, bar_ts, probs): of each row given its whole chain, forward and backward."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p, x = hmm._ordered(p, obs)
        if not len(x):
            return pd.DataFrame({"symbol": [], "bar_ts": [], "probs": []})
        f, _, _ = hmm.forward(m, x)
        g = f.copy()
        for t in range(len(x) - 2, -1, -1):
            ahead = f[t] @ m.move
            g[t] = f[t] * (m.move @ np.divide(g[t + 1], ahead, out=np.zeros_like(ahead), where=ahead > 0))
        return pd.DataFrame({"symbol": p.symbol, "bar_ts": p.bar_ts, "probs": list(g)})

    return spread(rows.select("symbol", "bar_ts", *obs), "symbol").groupBy("symbol").applyInPandas(one, "symbol string, bar_ts timestamp, probs array<double>")


def split(rows: DataFrame, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The earlier rows of each symbol, and the last share of them."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol")
    d = rows.withColumn("_i", F.row_number().over(w.orderBy("bar_ts"))).withColumn("_n", F.count("*").over(w))
    early = F.col("_i") <= F.floor(F.col("_n") * (1 - share))
    return d.where(early).drop("_i", "_n"), d.where(~early).drop("_i", "_n")


def searched(rows: DataFrame, obs: list[str], states: list[int], rounds: int = 20, folds: int = 0) -> list[dict]:
    """A fit for each number of states, with its criteria and, with folds, the mean log likelihood a row on later parts; best by bic first."""
    out = []
    for k in states:
        m, _ = hmm.fit(rows, obs, k, rounds)
        row = {"states": k, "model": m, **evaluate(rows, m, obs)}
        if folds:
            cut = expanding(rows.dropna(subset=obs), folds)
            scores = []
            for f in range(folds):
                own = cut.where(F.col("fold") == f)
                fold_model, _ = hmm.fit(own.where("part = 'train'"), obs, k, rounds)
                got = evaluate(own.where("part = 'test'"), fold_model, obs)
                scores.append(-math.log(got["perplexity"]))
            row["cv"] = float(np.mean(scores))
        out.append(row)
    return sorted(out, key=lambda r: r["bic"])


def sensitivity(run, name: str, values: list, **fixed) -> list[dict]:
    """run(**parameters) -> a number, for each value of one parameter; and the spread of the numbers."""
    rows = [{"parameter": name, "value": v, "score": float(run(**{**fixed, name: v}))} for v in values]
    spread = max(r["score"] for r in rows) - min(r["score"] for r in rows)
    return [{**r, "spread": spread} for r in rows]


def weights_by_state(rows: DataFrame, m: hmm.Model, obs: list[str], signals: list[str], r: str = "r", steps: int = 10) -> DataFrame:
    """(state, n, w_0, ..., sharpe): the states on each chain's likeliest path, and the best weights on a grid for each state."""
    states = hmm.infer(rows, m, obs).select("symbol", "bar_ts", "state")
    return grid_weights(rows.join(states, ["symbol", "bar_ts"]), signals, r, ("state",), steps)


def performance_weights(log_likelihoods: list[float]) -> list[float]:
    """Likelihoods less the least one, as shares; equal ones where all are the same."""
    low = min(log_likelihoods)
    x = [v - low for v in log_likelihoods]
    return [v / sum(x) for v in x] if sum(x) > 0 else [1 / len(x)] * len(x)


def diversity_weights(disagreement: np.ndarray) -> list[float]:
    """Members' mean disagreement with the others, as shares."""
    x = disagreement.sum(axis=1) / max(1, len(disagreement) - 1)
    return (x / x.sum()).tolist() if x.sum() > 0 else [1 / len(x)] * len(x)
