"""Joins of time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, value: str, ts: str = "bar_ts") -> DataFrame:
    """left with the value of right's last row at or before its time, by symbol: one union and one running window, no pairs."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_own", F.lit(1))
    known = right.select("symbol", ts, F.col(value).alias("_v"), F.lit(0).alias("_own"))
    w = Window.partitionBy("symbol").orderBy(ts, "_own").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(known, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return out.where("_own = 1").drop("_v", "_own")


def aligned(a: DataFrame, b: DataFrame, ts: str = "bar_ts") -> tuple[DataFrame, DataFrame]:
    """Both tables cut to their common symbols and their common span of time."""
    ends = [d.agg(F.min(ts).alias(f"lo{k}"), F.max(ts).alias(f"hi{k}")) for k, d in enumerate((a, b))]
    span = ends[0].join(ends[1]).select(F.greatest("lo0", "lo1").alias("_lo"), F.least("hi0", "hi1").alias("_hi"))  # one row

    def cut(d: DataFrame, other: DataFrame) -> DataFrame:
        kept = d.join(other.select("symbol").distinct(), "symbol", "left_semi")
        return kept.join(F.broadcast(span), F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")

    return cut(a, b), cut(b, a)


def against_market(returns: DataFrame) -> DataFrame:
    """returns(symbol, bar_ts, r) -> beta, alpha and correlation of each symbol with the mean return of all at its times."""
    market = returns.where("r is not null").groupBy("bar_ts").agg(F.avg("r").alias("m"))
    return returns.join(market, "bar_ts").groupBy("symbol").agg(F.regr_slope("r", "m").alias("beta"), F.regr_intercept("r", "m").alias("alpha"), F.corr("r", "m").alias("corr"), F.count("r").alias("n"))


def combined(tables: dict[str, DataFrame], keys=("symbol", "bar_ts")) -> DataFrame:
    """All tables side by side by symbol and time; columns that several have get the later table's name behind them."""
    out = None
    for name, d in tables.items():
        if out is not None:
            d = d.toDF(*[c if c in keys or c not in out.columns else f"{c}_{name}" for c in d.columns])
        out = d if out is None else out.join(d, list(keys), "full_outer")
    return out


def coverage(signals: DataFrame, market: DataFrame, ts: str = "bar_ts", least: float = 0.8) -> DataFrame:
    """(symbol, covered, sparse): the share of a symbol's signals that have a bar of their time."""
    there = market.select("symbol", ts, F.lit(1).alias("_there")).distinct()
    d = signals.join(there, ["symbol", ts], "left").groupBy("symbol").agg(F.avg(F.coalesce("_there", F.lit(0)).cast("double")).alias("covered"))
    return d.withColumn("sparse", F.col("covered") < least)


def reconciled(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(symbol, expected, actual, diff) of positions that differ, either side may lack one."""
    e, a = expected.select("symbol", F.col("quantity").alias("expected")), actual.select("symbol", F.col("quantity").alias("actual"))
    d = e.join(a, "symbol", "full_outer").na.fill(0.0, ["expected", "actual"])
    return d.withColumn("diff", F.col("actual") - F.col("expected")).where(F.abs("diff") > tolerance)
