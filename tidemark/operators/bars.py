"""Bars from ticks, and window indicators on bars(symbol, bar_ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, unit: str = "hour", symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars of one unit of time. Open and close go by (ts, tie), so they don't depend on the order of rows; partial aggregates combine before the shuffle."""
    at = F.struct(ts, tie)
    return ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("bar_ts")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume")
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as there are cores at least: small tables whose groups are much work each would else be one task's."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def corr(x, y) -> Column:
    """Pearson's correlation; null where a side doesn't vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    whole = x.isNotNull() & y.isNotNull()
    x, y = F.when(whole, x), F.when(whole, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def divided(x, y) -> Column:
    """x / y as floating point has it: by 0 an infinity, or not a number."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when(y == 0, x.cast("double") * float("inf")).otherwise(x / y)


def by_symbol():
    return Window.partitionBy("symbol").orderBy("bar_ts")


def last(n: int, skip: int = 0):
    """A frame of n rows that ends skip rows before the current one."""
    return by_symbol().rowsBetween(-(n - 1) - skip, -skip)


def back(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())


def when_full(x: Column, n: int, over: str = "close") -> Column:
    return F.when(F.count(over).over(last(n)) >= n, x)


def sma(n: int = 20, c: str = "close") -> Column:
    return F.avg(c).over(last(n))


def std(n: int = 20, c: str = "close") -> Column:
    return F.stddev_samp(c).over(last(n))


def std_in_order(n: int = 20, c: str = "close") -> Column:
    """std by Welford's steps in the order of bars, with the increments as (x - mean before) * (x - mean after): for where a rounding in the last bit
    decides."""
    empty = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["m2"] + (x - mean) * (x - a["mean"])).alias("m2"))

    return F.aggregate(F.collect_list(F.col(c).cast("double")).over(last(n)), empty, step, lambda a: F.when(a["n"] > 1, F.sqrt(a["m2"] / (a["n"] - 1))))


def zscore(n: int = 20) -> Column:
    return (F.col("close") - sma(n)) / F.nullif(std(n), F.lit(0.0))


def momentum() -> Column:
    prev = back("close")
    return F.when(prev.isNull() | (prev == 0), 0.0).otherwise(F.col("close") / prev - 1)


def true_range() -> Column:
    prev = back("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def mean_reversion(n: int = 20, least: float = 1e-8) -> Column:
    """The z-score turned and divided by the deviation once more."""
    return -zscore(n) / F.greatest(std(n), F.lit(least))


def future_return(h: int, c: str = "close") -> Column:
    return (F.lead(c, h).over(by_symbol()) - F.col(c)) / F.nullif(F.col(c), F.lit(0.0))


def direction(h: int = 4) -> Column:
    return F.signum(F.lead("close", h).over(by_symbol()) - F.col("close")).cast("int")


def label_of(ret: Column, buy: float = 0.02, sell: float = -0.02) -> Column:
    return F.when(ret > buy, "Buy").when(ret < sell, "Sell").when(ret.isNotNull(), "Hold")


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """bars with cci; the mean deviation takes each bar's own mean."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = bars.withColumn("_tp", tp).withColumn("_mean", F.avg("_tp").over(last(n))).withColumn("_off", F.abs(F.col("_tp") - F.col("_mean"))).withColumn("_dev", F.avg("_off").over(last(n)))
    full = F.count("_tp").over(last(n)) >= min(n, 10)
    return d.withColumn("cci", F.when(full & (F.col("_dev") * 0.015 > 1e-10), (F.col("_tp") - F.col("_mean")) / (0.015 * F.col("_dev")))).drop("_tp", "_mean", "_off", "_dev")


def kernel(weights: list[float], c: str = "close") -> Column:
    """Weighted mean of the current and earlier rows, the current one first; rows that don't exist take no part."""
    w = by_symbol()
    terms = [(F.lag(c, i).over(w), x) for i, x in enumerate(weights)]
    top = sum((F.coalesce(v * x, F.lit(0.0)) for v, x in terms[1:]), F.coalesce(terms[0][0] * weights[0], F.lit(0.0)))
    return top / sum((F.when(v.isNotNull(), x).otherwise(0.0) for v, x in terms[1:]), F.when(terms[0][0].isNotNull(), weights[0]).otherwise(0.0))


def rational_quadratic(lookback: float = 8.0, r: float = 8.0, size: int = 12) -> list[float]:
    return [(1 + i * i / (2 * lookback**2 * r)) ** -r for i in range(size)]


def gaussian(lookback: float = 8.0, size: int = 12) -> list[float]:
    from math import exp

    return [exp(-i * i / (2 * lookback**2)) for i in range(size)]


def drawdowns(bars: DataFrame) -> DataFrame:
    peak = F.max("close").over(by_symbol())
    return bars.withColumn("peak", peak).withColumn("drawdown", (F.col("close") - F.col("peak")) / F.col("peak"))


def regimes(bars: DataFrame, n: int = 20, volatile: float = 0.02, trending: float = 0.001) -> DataFrame:
    """bars with regime: by the deviation of n - 1 returns and the slope of n closes over their mean; null until the frame is full."""
    d = bars.withColumn("_i", F.row_number().over(by_symbol()).cast("double")).withColumn("_r", F.col("close") / back("close") - 1)
    slope = F.regr_slope("close", "_i").over(last(n)) / sma(n)
    vol = F.stddev_pop("_r").over(last(n - 1))
    return d.withColumn("regime", F.when(F.col("_i") < n, F.lit(None)).when(vol > volatile, "Volatile").when(F.abs(slope) > trending, "Trending").otherwise("Ranging")).drop("_i", "_r")
