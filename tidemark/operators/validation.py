"""Walk-forward windows, folds, comparisons in and out of sample, regressions of models, weights by search, ensembles and choices among models."""

from __future__ import annotations

import itertools
import math
import re
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAYS = {"D": 1, "W": 7, "M": 30, "Y": 365}


def period(text: str) -> timedelta:
    """6M is 180 days."""
    m = re.fullmatch(r"(\d+)([DWMY])", text.strip().upper())
    if not m:
        raise ValueError(f"unknown period {text!r}")
    return timedelta(days=int(m[1]) * DAYS[m[2]])


def windows(spark: SparkSession, first: datetime, last: datetime, train: str, test: str, step: str) -> DataFrame:
    """(window, train_start, train_end, test_start, test_end): sliding windows whose tests end by last. A row each."""
    out, at = [], first
    while at + period(train) + period(test) <= last:
        mid = at + period(train)
        out.append((len(out), at, mid, mid, mid + period(test)))
        at += period(step)
    return spark.createDataFrame(out, "window int, train_start timestamp, train_end timestamp, test_start timestamp, test_end timestamp")


def windowed(rows: DataFrame, wins: DataFrame, ts: str = "bar_ts") -> DataFrame:
    """rows in each window that holds them, with part train or test. Windows are few, so they are broadcast."""
    t = F.col(ts)
    d = rows.join(F.broadcast(wins), (t >= F.col("train_start")) & (t < F.col("test_end")))
    return d.withColumn("part", F.when(t < F.col("train_end"), "train").otherwise("test")).drop("train_start", "train_end", "test_start", "test_end")


def separated(train: DataFrame, test: DataFrame, ts: str = "bar_ts") -> bool:
    """Whether all of train is before all of test."""
    a, b = train.agg(F.max(ts)).first()[0], test.agg(F.min(ts)).first()[0]
    return a is None or b is None or a < b


def expanding(rows: DataFrame, folds: int, keys=("symbol",), order: str = "bar_ts") -> DataFrame:
    """rows with fold and part: of n rows cut in folds + 1 parts of floor(n / (folds + 1)), fold k tests on part k + 1 (the last one with the rest) and trains
    on all before; a row comes once for each fold that uses it."""
    w = Window.partitionBy(*keys)
    size = F.greatest(F.floor(F.count("*").over(w) / (folds + 1)), F.lit(1))
    part = F.least(F.floor((F.row_number().over(w.orderBy(order)) - 1) / size), F.lit(folds)).cast("int")
    d = rows.withColumn("_p", part).withColumn("fold", F.explode(F.sequence(F.greatest(F.col("_p") - 1, F.lit(0)), F.lit(folds - 1))))
    return d.where(F.col("_p") <= F.col("fold") + 1).withColumn("part", F.when(F.col("_p") == F.col("fold") + 1, "test").otherwise("train")).drop("_p")


def strategy_metrics(rows: DataFrame, r: str, keys, order: str = "bar_ts", per_year: float = 252.0) -> DataFrame:
    """(keys, n, sharpe, total, volatility, max_drawdown, win_rate) of returns; the drawdown is that of their running sum."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = rows.where(F.col(r).isNotNull()).withColumn("_c", F.sum(r).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_d", F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.sum(r).alias("total"), F.max("_d").alias("max_drawdown"), F.avg((F.col(r) > 0).cast("double")).alias("win_rate"))
    return out.withColumns({"sharpe": F.coalesce(F.col("_m") / F.nullif("_s", F.lit(0.0)) * per_year**0.5, F.lit(0.0)), "volatility": F.coalesce(F.col("_s") * per_year**0.5, F.lit(0.0))}).drop("_m", "_s")


def fold_report(by_fold: DataFrame, metric: str = "sharpe", keys=("symbol",), threshold: float = 0.3) -> DataFrame:
    """by_fold(keys, fold, part, metric) -> (keys, n_folds, in_sample, out_of_sample, degradation: mean, std, least, most; consistency, stability,
    positive, overfit): how much of the metric in sample is lost out of it."""
    d = by_fold.groupBy(*keys, "fold").agg(F.max(F.when(F.col("part") == "train", F.col(metric))).alias("a"), F.max(F.when(F.col("part") == "test", F.col(metric))).alias("b"))
    d = d.withColumn("lost", (F.col("a") - F.col("b")) / F.nullif(F.abs("a"), F.lit(0.0)))
    out = d.groupBy(*keys).agg(
        F.count("*").alias("n_folds"), F.avg("a").alias("in_sample"), F.avg("b").alias("out_of_sample"), F.avg("lost").alias("lost_mean"), F.stddev_samp("lost").alias("lost_std"), F.min("lost").alias("lost_least"), F.max("lost").alias("lost_most"),
        F.avg((F.col("b") > 0).cast("double")).alias("positive"), F.stddev_pop("b").alias("_s"), F.regr_slope("b", F.col("fold").cast("double")).alias("trend"),
    )
    out = out.withColumn("stability", F.greatest(1 - F.col("_s") / F.nullif(F.abs("out_of_sample"), F.lit(0.0)), F.lit(0.0))).drop("_s")
    return out.withColumn("overfit", F.coalesce((F.col("lost_mean") > threshold) | (F.col("lost_most") > 1.5 * threshold), F.lit(False)))


def retrained(by_window: DataFrame, metric: str, threshold: float = 0.2, keys=("symbol",)) -> DataFrame:
    """by_window with retrain: whether the metric lost more than a share of the window's before."""
    before = F.lag(metric).over(Window.partitionBy(*keys).orderBy("window"))
    return by_window.withColumn("retrain", F.coalesce((before - F.col(metric)) / F.nullif(F.abs(before), F.lit(0.0)) > threshold, F.lit(False)))


def regressions(history: DataFrame, metric: str, n: int = 5, threshold: float = 0.1, keys=("symbol",), order: str = "bar_ts", higher_is_better: bool = True) -> DataFrame:
    """history with baseline, baseline_std, change, t and alert: the metric against the n values before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    d = history.withColumns({"baseline": F.avg(metric).over(w), "baseline_std": F.stddev_samp(metric).over(w), "_n": F.count(metric).over(w)})
    sign = 1 if higher_is_better else -1
    d = d.withColumn("change", sign * (F.col(metric) - F.col("baseline")) / F.nullif(F.abs("baseline"), F.lit(0.0)))
    d = d.withColumn("t", (F.col(metric) - F.col("baseline")) / F.nullif(F.col("baseline_std") / F.sqrt("_n"), F.lit(0.0)))
    return d.withColumn("alert", (F.col("_n") >= n) & F.coalesce(F.col("change") < -threshold, F.lit(False)) & F.coalesce(F.abs("t") > 2, F.lit(False))).drop("_n")


def simplex(names: int, steps: int = 10) -> list[tuple[float, ...]]:
    """All weights in steps that sum to 1, in ascending order."""
    return [tuple(k / steps for k in x) for x in itertools.product(range(steps + 1), repeat=names) if sum(x) == steps]


def grid_weights(rows: DataFrame, signals: list[str], r: str = "r", keys=("symbol",), steps: int = 10, per_year: float = 252.0, least_rows: int = 30) -> DataFrame:
    """(keys, n, w_0, w_1, ..., sharpe): of the weights on a grid, those whose side, the sign of the weighed signals, earned the largest Sharpe ratio; the first
    of equals. Equal weights where there are too few rows or returns don't vary. All sums of the grid are taken in one pass."""
    grid = simplex(len(signals), steps)
    total = lambda w: sum((F.col(s) * x for s, x in zip(signals, w)), F.lit(0.0))
    d = rows.select(*keys, r, F.posexplode(F.array(*[F.signum(total(w)) * F.col(r) for w in grid])).alias("g", "p"))
    each = d.groupBy(*keys, "g").agg(F.count("p").alias("n"), F.avg("p").alias("m"), F.stddev_samp("p").alias("s"), F.stddev_samp(r).alias("v"))
    each = each.withColumn("sharpe", F.round(F.coalesce(F.col("m") / F.nullif("s", F.lit(0.0)) * per_year**0.5, F.lit(0.0)), 9))
    best = each.groupBy(*keys).agg(F.max("n").alias("n"), F.max("v").alias("v"), F.max_by(F.struct("g", "sharpe"), F.struct("sharpe", -F.col("g"))).alias("x"))
    fine = (F.col("n") >= least_rows) & (F.col("v") > 0)
    w = [F.when(fine, F.element_at(F.array(*[F.lit(g[i]) for g in grid]), F.col("x.g") + 1)).otherwise(1 / len(signals)).alias(f"w_{i}") for i in range(len(signals))]
    return best.select(*keys, "n", *w, F.when(fine, F.col("x.sharpe")).alias("sharpe"))


def normalised(value: Column, keys, higher_is_better: bool = True) -> Column:
    """(v - min) / (max - min) of a group, turned if lower is better; 1 where all are equal."""
    w = Window.partitionBy(*keys)
    x = (value - F.min(value).over(w)) / F.nullif(F.max(value).over(w) - F.min(value).over(w), F.lit(0.0))
    return F.coalesce(x if higher_is_better else 1 - x, F.lit(1.0))


def selected(models: DataFrame, weights: dict[str, float], lower: tuple[str, ...] = (), thresholds: dict[str, float] | None = None, keys=("symbol",), name: str = "model") -> DataFrame:
    """models(keys, name, metrics) with score, the weighed sum of normalised metrics (none where a metric is under its threshold), and place."""
    d = models.withColumns({f"_{m}": normalised(F.col(m), keys, m not in lower) for m in weights})
    score = sum((F.col(f"_{m}") * w for m, w in weights.items()), F.lit(0.0))
    for m, t in (thresholds or {}).items():
        score = F.when(F.col(m) < t, float("-inf")).otherwise(score)
    d = d.withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), name)))
    return d.drop(*[f"_{m}" for m in weights])


def ensemble(members: DataFrame, keys=("symbol", "bar_ts"), weight: str = "weight") -> DataFrame:
    """members(keys, member, weight, p_0, p_1, ...) -> the weighed mean of posteriors, the likeliest state, and the share of members that agree with it."""
    ps = sorted(c for c in members.columns if c.startswith("p_"))
    arr = F.array(*ps)
    d = members.withColumn("_own", F.array_position(arr, F.array_max(arr)) - 1)
    out = d.groupBy(*keys).agg(*[(F.sum(F.col(p) * F.col(weight)) / F.sum(weight)).alias(p) for p in ps], F.collect_list("_own").alias("_all"))  # one entry a member
    both = F.array(*ps)
    out = out.withColumn("state", (F.array_position(both, F.array_max(both)) - 1).cast("int"))
    return out.withColumn("agreement", F.size(F.filter("_all", lambda x: x == F.col("state"))) / F.size("_all")).drop("_all")


def disagreement(decoded: DataFrame, keys=("symbol",), order: str = "bar_ts") -> DataFrame:
    """decoded(keys, order, member, state) -> (keys, a, b, share): how often two members differ. Members of a time meet; they are few."""
    a = decoded.select(*keys, order, F.col("member").alias("a"), F.col("state").alias("sa"))
    b = decoded.select(*keys, order, F.col("member").alias("b"), F.col("state").alias("sb"))
    return a.join(b, [*keys, order]).where("a < b").groupBy(*keys, "a", "b").agg(F.avg((F.col("sa") != F.col("sb")).cast("double")).alias("share"))


def interaction(grid: DataFrame, a: str, b: str, value: str, keys=()) -> DataFrame:
    """(keys, strength): the share of a grid's variance that the sum of the means of its two parameters doesn't tell."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    d = grid.withColumns({"_a": F.avg(value).over(Window.partitionBy(*keys, a)), "_b": F.avg(value).over(Window.partitionBy(*keys, b)), "_m": F.avg(value).over(own)})
    rest = F.col(value) - (F.col("_a") + F.col("_b") - F.col("_m"))
    return d.groupBy(*keys).agg(F.coalesce(F.var_pop(rest) / F.nullif(F.var_pop(value), F.lit(0.0)), F.lit(0.0)).alias("strength"))


def latest(versions: DataFrame, keys=("experiment",), version: str = "version") -> DataFrame:
    """The largest version of each key by its numbers."""
    parts = F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: x.cast("int"))
    return versions.groupBy(*keys).agg(F.max_by(version, parts).alias(version))


def _encoded(space: dict, point: dict) -> list[float]:
    """A point as numbers from 0 to 1: a range by its place, a list of choices by one number each."""
    out: list[float] = []
    for name, own in space.items():
        if isinstance(own, list):
            out += [float(point[name] == v) for v in own]
        else:
            out.append((point[name] - own[0]) / ((own[1] - own[0]) or 1))
    return out


def _guess(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of a Gaussian process (Matern 5/2) through (x, y); its length is that of the largest likelihood among some."""

    def kernel(a, b, length):
        r = np.sqrt(5 * np.maximum(((a[:, None] - b[None]) ** 2).sum(2), 0)) / length
        return (1 + r + r * r / 3) * np.exp(-r)

    best = None
    for length in (0.1, 0.2, 0.4, 0.8, 1.6):
        low = np.linalg.cholesky(kernel(x, x, length) + 1e-6 * np.eye(len(x)))
        w = np.linalg.solve(low.T, np.linalg.solve(low, y))
        fit = -0.5 * y @ w - np.log(np.diag(low)).sum()
        if best is None or fit > best[0]:
            best = fit, length, low, w
    _, length, low, w = best
    k = kernel(at, x, length)
    return k @ w, np.sqrt(np.maximum(1 - (np.linalg.solve(low, k.T) ** 2).sum(0), 1e-12))


def bayesian(run, space: dict[str, tuple | list], calls: int = 100, first: int = 10, seed: int = 0, higher_is_better: bool = True) -> list[dict]:
    """(params, score, error) of each call of run(**params) -> a number, the best first, failed ones last. space: name -> (low, high), of whole numbers if
    both are, or a list of choices. After some random points each is that of the largest expected improvement. run does the distributed work;
    what is kept here grows with the calls alone."""
    rng = np.random.default_rng(seed)

    def draw() -> dict:
        out = {}
        for name, own in space.items():
            if isinstance(own, list):
                out[name] = own[int(rng.integers(len(own)))]
            else:
                whole = all(isinstance(v, int) for v in own)
                out[name] = int(rng.integers(own[0], own[1] + 1)) if whole else float(rng.uniform(*own))
        return out

    out: list[dict] = []
    sign = 1.0 if higher_is_better else -1.0
    for call in range(calls):
        done = [r for r in out if r["score"] is not None]
        point = draw()
        if call >= first and len(done) > 1:
            y = sign * np.array([r["score"] for r in done])
            y = (y - y.mean()) / (y.std() or 1.0)
            some = [draw() for _ in range(1000)]
            top = done[int(np.argmax(y))]["params"]
            some += [{**top, name: other[name]} for other in some[:200] for name in space]  # near the best: one parameter drawn anew
            seen = [r["params"] for r in out]
            some = [p for p in some if p not in seen] or some
            mean, std = _guess(np.array([_encoded(space, r["params"]) for r in done]), y, np.array([_encoded(space, p) for p in some]))
            z = (mean - y.max()) / std
            gain = (mean - y.max()) * np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z]) + std * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            point = some[int(np.argmax(gain))]
        try:
            score, error = float(run(**point)), None
            if not math.isfinite(score):
                score, error = None, "not a finite number"
        except Exception as e:  # a failed trial is a result of its own
            score, error = None, str(e)
        out.append({"params": point, "score": score, "error": error})
    return sorted(out, key=lambda r: (r["score"] is None, -sign * (r["score"] or 0.0)))
