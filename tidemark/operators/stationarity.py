"""Augmented Dickey-Fuller tests: a series' regressions share one matrix of sums of products, added up over batches of its rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: MacKinnon's response surface of the test with a constant, polynomials in the statistic below and above a cut, and where p is 0 or 1.
SMALL, LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
CUT, LEAST, MOST = -1.61, -18.83, 2.74
LEAST_ROWS = 20


def p_value(t: float) -> float:
    if t > MOST or t < LEAST:
        return float(t > MOST)
    z = sum(c * t**i for i, c in enumerate(SMALL if t <= CUT else LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def most_lags(n: Column) -> Column:
    return F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2).cast("int")


def _sums(rows: DataFrame, series: DataFrame, keys: list[str], value: str, order: str, lag: str) -> DataFrame:
    """series with gram: sums of products of 1, the value before, the moves 1, ..., lag back and the move, over the rows that have all of them."""
    most = series.agg(F.max(lag)).first()[0] or 0
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(most + 1), 0)
    d = rows.join(series.select(*keys, F.col(lag).alias("_m"), "mean"), keys).withColumn("_x", F.collect_list(F.col(value) - F.col("mean")).over(past))
    d = d.where(F.size("_x") >= F.col("_m") + 2).select(*keys, "_m", F.slice("_x", -(F.col("_m") + 2), F.col("_m") + 2).alias("_x"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, own in b.groupby(keys, dropna=False, sort=False):
                x = np.stack(own["_x"].to_list())
                moves = np.diff(x, axis=1)
                z = np.hstack([np.ones((len(x), 1)), x[:, -2:-1], moves[:, -2::-1], moves[:, -1:]])
                out.append((*key, (z.T @ z).ravel()))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "gram"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    parts = d.mapInPandas(each, f"{kinds}, gram array<double>").select(*keys, F.posexplode("gram").alias("i", "v"))
    whole = parts.groupBy(*keys, "i").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    return series.join(whole.select(*keys, F.col("x.v").alias("gram")), keys)


def _solved(gram: np.ndarray, lags: int) -> tuple[float, float]:
    """(residual sum of squares, t of the value before) of the regression of the move on a constant, the value before and the first so many moves."""
    k = lags + 2
    a, b, n = gram[:k, :k], gram[:k, -1], gram[0, 0]
    inverse = np.linalg.pinv(a, hermitian=True)
    beta = inverse @ b
    rest = max(float(gram[-1, -1] - b @ beta), 1e-14 * float(gram[-1, -1]), 1e-300)
    se = math.sqrt(rest / (n - k) * inverse[1, 1]) if n > k and inverse[1, 1] > 0 else math.nan
    return rest, float(beta[1] / se) if se else math.nan


def adf(rows: DataFrame, value: str = "close", keys=("symbol",), order: str = "bar_ts", lags: int | None = None, level: float = 0.05) -> DataFrame:
    """(keys, n, lags, statistic, p, stationary): tests for a unit root with a constant. Without lags, those of the least Akaike criterion among up to
    ceil(12 (n / 100)^(1/4)), compared over the same rows. Nulls and numbers that aren't finite are left out; series of under 20 rows, or that don't
    vary, have no row."""
    keys = list(keys)
    x = F.col(value).cast("double")
    d = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*keys, order, x.alias(value))
    series = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("_a"), F.max(value).alias("_z"))
    series = series.where((F.col("n") >= LEAST_ROWS) & (F.col("_a") < F.col("_z"))).drop("_a", "_z")
    if lags is None:

        @F.pandas_udf("int")
        def chosen(gram: pd.Series) -> pd.Series:
            out = []
            for g in gram:
                side = math.isqrt(len(g))
                g = np.reshape(g, (side, side))
                fits = [g[0, 0] * math.log(_solved(g, k)[0] / g[0, 0]) + 2 * (k + 2) for k in range(side - 2)]
                out.append(int(np.argmin(fits)))
            return pd.Series(out)

        series = _sums(d, series.withColumn("_most", most_lags(F.col("n"))), keys, value, order, "_most")
        series = series.withColumn("lags", chosen("gram")).drop("gram", "_most")
    else:
        series = series.withColumn("lags", F.least(F.lit(lags), most_lags(F.col("n"))))

    @F.pandas_udf("statistic double, p double")
    def tested(gram: pd.Series) -> pd.DataFrame:
        t = [_solved(np.reshape(g, (math.isqrt(len(g)), -1)), math.isqrt(len(g)) - 3)[1] for g in gram]
        return pd.DataFrame({"statistic": t, "p": [p_value(v) if math.isfinite(v) else None for v in t]}, dtype="float64")

    out = _sums(d, series, keys, value, order, "lags").withColumn("x", tested("gram"))
    return out.select(*keys, "n", "lags", "x.statistic", "x.p", (F.col("x.p") <= level).alias("stationary"))
