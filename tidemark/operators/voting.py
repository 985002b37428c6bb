"""Nearest-neighbour voting of bars by Lorentzian distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import by_symbol


def lorentzian(features: list[str], a: str = "q_", b: str = "c_") -> Column:
    """Sum of ln(1 + |difference|) over the features, rounded so that ties don't hang on the order of summation."""
    return F.round(reduce(lambda x, y: x + y, [F.log1p(F.abs(F.col(a + f) - F.col(b + f))) for f in features]), 9)


def vote(rows: DataFrame, features: list[str], k: int = 8, spacing: int = 4, back: int = 2000) -> DataFrame:
    """rows(symbol, bar_ts, label, features) -> (symbol, bar_ts, vote, n, radius): the summed labels of the k nearest of
    every spacing-th earlier bar, from spacing to back bars old; ties go to the older bar. The range join meets on
    (symbol, block of back bars), so a long series is dealt out in blocks of bounded size."""
    known = reduce(lambda x, y: x & y, [F.col(f).isNotNull() for f in features])
    d = rows.withColumn("_i", (F.row_number().over(by_symbol()) - 1).cast("long")).withColumn("_b", F.floor(F.col("_i") / back)).where(known)
    q = d.select("symbol", "bar_ts", "_i", F.explode(F.array(F.col("_b") - 1, F.col("_b"))).alias("_b"), *[F.col(f).alias(f"q_{f}") for f in features])
    c = d.where(F.col("label").isNotNull() & (F.col("_i") % spacing == 0)).select("symbol", "_b", F.col("_i").alias("_j"), "label", *[F.col(f).alias(f"c_{f}") for f in features])
    pairs = q.join(c, ["symbol", "_b"]).where((F.col("_j") <= F.col("_i") - spacing) & (F.col("_j") >= F.col("_i") - back))
    near = pairs.select("symbol", "bar_ts", "_j", "label", lorentzian(features).alias("_d"))
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "bar_ts").orderBy("_d", "_j"))).where(F.col("_n") <= k)
    return best.groupBy("symbol", "bar_ts").agg(F.sum("label").alias("vote"), F.count("*").alias("n"), F.max("_d").alias("radius"))
