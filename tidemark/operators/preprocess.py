"""Preparation of columns: missing values, logarithms, trends, outliers, scales, principal components; each step learned on one table can be replayed on
another from a few numbers a group."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import by_symbol


def filled(df: DataFrame, c: str, how: str) -> Column:
    """forward (then backward), backward (then forward), linear by position between known neighbours (the ends take the nearest), or the symbol's mean."""
    w = by_symbol()
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    last, nxt = F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)
    if how == "forward":
        return F.coalesce(last, nxt)
    if how == "backward":
        return F.coalesce(nxt, last)
    if how == "mean":
        return F.coalesce(F.col(c), F.avg(c).over(Window.partitionBy("symbol")))
    if how == "linear":
        at = F.when(F.col(c).isNotNull(), F.col("_i"))
        a, b = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
        return F.coalesce(F.col(c), last + (nxt - last) * (F.col("_i") - a) / (b - a), last, nxt)
    raise ValueError(f"unknown way to fill: {how}")


def with_filled(df: DataFrame, c: str, hows=("forward", "backward", "linear", "mean")) -> DataFrame:
    """df with a column {c}_{how} for each way."""
    d = df.withColumn("_i", F.row_number().over(by_symbol()))
    return d.withColumns({f"{c}_{h}": filled(d, c, h) for h in hows}).drop("_i")


def logged(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """log(1 + x) of the columns of a symbol that are all over 0; others stay."""
    own = Window.partitionBy("symbol")
    return df.withColumns({c: F.when(F.min(c).over(own) > 0, F.log1p(c)).otherwise(F.col(c)) for c in columns})


def detrended(df: DataFrame, c: str) -> DataFrame:
    """df with c less its straight line over the rows of a symbol."""
    d = df.withColumn("_i", (F.row_number().over(by_symbol()) - 1).cast("double"))
    line = d.groupBy("symbol").agg(F.regr_slope(c, "_i").alias("_a"), F.regr_intercept(c, "_i").alias("_b"))
    return d.join(line, "symbol").withColumn(c, F.col(c) - F.coalesce(F.col("_a") * F.col("_i") + F.col("_b"), F.col(c))).drop("_i", "_a", "_b")


def bounds(df: DataFrame, c: str, how: str = "zscore", width: float = 3.0, keys=("symbol",)) -> DataFrame:
    """(keys, lower, upper): mean and deviations, or quartiles (interpolated) and widths of their distance."""
    if how == "zscore":
        return df.groupBy(*keys).agg((F.avg(c) - width * F.stddev_samp(c)).alias("lower"), (F.avg(c) + width * F.stddev_samp(c)).alias("upper"))
    q = df.groupBy(*keys).agg(F.percentile(c, 0.25).alias("a"), F.percentile(c, 0.75).alias("b"))
    return q.select(*keys, (F.col("a") - width * (F.col("b") - F.col("a"))).alias("lower"), (F.col("b") + width * (F.col("b") - F.col("a"))).alias("upper"))


def clipped(df: DataFrame, c: str, limits: DataFrame, remove: bool = False) -> DataFrame:
    """Values beyond the limits are brought to them, or removed and filled from before, then from behind."""
    d = df.join(F.broadcast(limits), [x for x in limits.columns if x not in ("lower", "upper")], "left")
    v = F.col(c)
    if not remove:
        return d.withColumn(c, F.when(v < F.col("lower"), F.col("lower")).when(v > F.col("upper"), F.col("upper")).otherwise(v)).drop("lower", "upper")
    d = d.withColumn(c, F.when((v < F.col("lower")) | (v > F.col("upper")), F.lit(None)).otherwise(v)).drop("lower", "upper")
    return d.withColumn(c, filled(d, c, "forward"))


def scale(df: DataFrame, c: str, how: str, keys=("symbol",)) -> DataFrame:
    """(keys, shift, factor) so that (x - shift) / factor is standard, within 0 .. 1, or about the median in widths of the quartiles."""
    d = df.groupBy(*keys)
    if how == "standard":
        out = d.agg(F.avg(c).alias("shift"), F.stddev_pop(c).alias("factor"))
    elif how == "minmax":
        out = d.agg(F.min(c).alias("shift"), (F.max(c) - F.min(c)).alias("factor"))
    elif how == "robust":
        out = d.agg(F.percentile(c, 0.5).alias("shift"), (F.percentile(c, 0.75) - F.percentile(c, 0.25)).alias("factor"))
    else:
        raise ValueError(f"unknown scale: {how}")
    return out.withColumn("factor", F.when(F.col("factor") == 0, 1.0).otherwise(F.col("factor")))


def scaled(df: DataFrame, c: str, by: DataFrame, out: str | None = None) -> DataFrame:
    keys = [x for x in by.columns if x not in ("shift", "factor")]
    return df.join(F.broadcast(by), keys, "left").withColumn(out or c, (F.col(c) - F.col("shift")) / F.col("factor")).drop("shift", "factor")


@dataclass
class Pipeline:
    """missing -> log -> trend -> outliers -> scale of one column, learned by fit and replayed by apply (with the same limits and scale)."""

    column: str
    fill: str = "forward"
    log: bool = True
    trend: bool = False
    outliers: str = "zscore"
    scaling: str = "standard"
    limits: DataFrame | None = None
    scaler: DataFrame | None = None

    def _early(self, df: DataFrame) -> DataFrame:
        d = with_filled(df, self.column, (self.fill,))
        d = d.withColumn(self.column, F.col(f"{self.column}_{self.fill}")).drop(f"{self.column}_{self.fill}")
        d = logged(d, [self.column]) if self.log else d
        return detrended(d, self.column) if self.trend else d

    def fit(self, df: DataFrame) -> Pipeline:
        d = self._early(df)
        self.limits = bounds(d, self.column, self.outliers)
        self.scaler = scale(clipped(d, self.column, self.limits), self.column, self.scaling)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return scaled(clipped(self._early(df), self.column, self.limits), self.column, self.scaler)


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    axes: np.ndarray  # (components, columns)
    share: np.ndarray


def principal(df: DataFrame, columns: list[str], n: int) -> Components:
    """Principal components of centred columns, from one pass of sums and products; the largest weight of an axis is positive."""
    whole = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = whole.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
    cov = np.zeros((len(columns), len(columns)))
    for k, (a, b) in enumerate(pairs):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = got[f"c{k}"] or 0.0
    value, axis = np.linalg.eigh(cov)
    order = np.argsort(-value)[:n]
    axes = axis[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Components(np.array([got[f"m{i}"] or 0.0 for i in range(len(columns))]), axes, value[order] / max(value.sum(), 1e-300))


def projected(df: DataFrame, columns: list[str], c: Components) -> DataFrame:
    """df with pc_1, pc_2, ...; null where a column is."""
    out = {f"pc_{k + 1}": sum(((F.col(x) - float(m)) * float(a) for x, m, a in zip(columns, c.mean, axis)), F.lit(0.0)) for k, axis in enumerate(c.axes)}
    return df.withColumns(out)
