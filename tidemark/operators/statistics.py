"""Statistics of predictions: accuracy, quality, distribution, significance, corrections for many tests, and power."""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.special import inverse_normal, normal_cdf
from tidemark.operators.bars import corr

def binomial_p(successes: Column, trials: Column, null: float) -> Column:
    """Two-sided, by the normal approximation from 30 trials on; with fewer 0.05 where more than the expected succeed, else 0.5."""
    z = F.abs(successes - trials * null) / F.sqrt(trials * null * (1 - null))
    return F.when(trials >= 30, 2 * (1 - normal_cdf(z))).when(successes > trials * null, 0.05).otherwise(0.5)


def binomial_interval(successes: Column, trials: Column, level: float = 0.95) -> tuple[Column, Column]:
    p, z = successes / trials, inverse_normal(1 - (1 - level) / 2)
    half = z * F.sqrt(p * (1 - p) / trials)
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))


def normal_interval(mean: Column, std: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    half = inverse_normal(1 - (1 - level) / 2) * std / F.sqrt(n)
    return mean - half, mean + half


def bonferroni(p: Column, m: Column) -> Column:
    return F.least(p * m, F.lit(1.0))


def benjamini_hochberg(tests: DataFrame, keys=(), p: str = "p", name: str = "name") -> DataFrame:
    """tests with q, the adjusted p: the least of p * m / rank from this rank on. Groups of tests are small."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    d = tests.withColumn("_rank", F.row_number().over(own.orderBy(p, name))).withColumn("_m", F.count("*").over(own))
    up = own.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("q", F.least(F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(up), F.lit(1.0))).drop("_rank", "_m")


def confusion(rows: DataFrame, keys=("symbol",), predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """(keys, n, accuracy, and of long and short: precision, recall, f1; overall precision, recall and f1 weighted by share of predictions; hit_rate
    among predictions that take a side). Directions are -1, 0 and 1."""
    p, a = F.col(predicted), F.col(actual)
    sides = {"short": -1, "neutral": 0, "long": 1}
    counts = [F.count_if((p == v) & (a == v)).alias(f"tp_{s}") for s, v in sides.items()] + [F.count_if(p == v).alias(f"p_{s}") for s, v in sides.items()] + [F.count_if(a == v).alias(f"a_{s}") for s, v in sides.items()]
    d = rows.where(p.isNotNull() & a.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *counts)
    zero = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    for s in sides:
        d = d.withColumn(f"precision_{s}", zero(F.col(f"tp_{s}"), F.col(f"p_{s}"))).withColumn(f"recall_{s}", zero(F.col(f"tp_{s}"), F.col(f"a_{s}")))
        both = F.col(f"precision_{s}") + F.col(f"recall_{s}")
        d = d.withColumn(f"f1_{s}", zero(2 * F.col(f"precision_{s}") * F.col(f"recall_{s}"), both))
    for m in ("precision", "recall", "f1"):
        d = d.withColumn(m, sum((F.col(f"{m}_{s}") * F.col(f"p_{s}") for s in sides), F.lit(0.0)) / F.col("n"))
    hits, taken = F.col("tp_short") + F.col("tp_long"), F.col("p_short") + F.col("p_long")
    return d.withColumn("accuracy", (hits + F.col("tp_neutral")) / F.col("n")).withColumn("hit_rate", zero(hits, taken))


def signal_quality(rows: DataFrame, keys=("symbol",), signal: str = "signal", ahead: str = "ahead") -> DataFrame:
    """(keys, n, noise_ratio, coefficient, mean_long, mean_short): mean over deviation, correlation with the next return (0 where it
    isn't defined), and the mean signal by side."""
    s = F.col(signal)
    return rows.where(s.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.abs(F.avg(s)) / F.nullif(F.stddev_samp(s), F.lit(0.0)), F.lit(0.0)).alias("noise_ratio"),
        F.coalesce(corr(s, F.col(ahead)), F.lit(0.0)).alias("coefficient"), F.avg(F.when(s > 0, s)).alias("mean_long"), F.avg(F.when(s < 0, s)).alias("mean_short"),
    )


def significance(rows: DataFrame, null: float = 1 / 3, keys=("symbol",)) -> DataFrame:
    """rows(keys, correct, signal) -> (keys, n, n_correct, p_accuracy, p_signal, low, high, signal_low, signal_high, power, enough): tests of the share of
    right predictions and of the size of the signal, with intervals of 95 %."""
    d = rows.where("correct is not null and signal is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.avg("signal").alias("m"), F.coalesce(F.stddev_samp("signal"), F.lit(0.0)).alias("s"), F.avg(F.col("signal") * F.col("signal")).alias("square"))
    n, k = F.col("n"), F.col("n_correct")
    low, high = binomial_interval(k, n)
    slow, shigh = normal_interval(F.col("m"), F.col("s"), n)
    return d.select(*keys, "n", "n_correct", binomial_p(k, n, null).alias("p_accuracy"), F.when(F.col("square") > 0.01, 0.01).otherwise(0.5).alias("p_signal"), low.alias("low"), high.alias("high"), slow.alias("signal_low"), shigh.alias("signal_high"), power(n).alias("power"), (n >= 30).alias("enough"))


def power(n: Column) -> Column:
    """By steps of the sample size."""
    return F.when(n < 30, 0.1).when(n < 100, 0.3).when(n < 300, 0.6).otherwise(0.8)


def power_for_effect(n: Column, effect: Column) -> Column:
    """A logistic curve of effect and size, within 0.05 and 0.99."""
    return F.least(F.greatest(1 / (1 + F.exp(-(effect * F.sqrt(n) - 1.96))), F.lit(0.05)), F.lit(0.99))


def required_size(effect: Column, wanted: Column) -> Column:
    """Rows needed to see an effect with a power: 64, 176, 1571 or 10000 by effect, times wanted / 0.8."""
    base = F.when(effect >= 0.8, 64).when(effect >= 0.5, 176).when(effect >= 0.2, 1571).otherwise(10_000)
    return F.ceil(base * wanted / 0.8)


def positional_thirds(rows: DataFrame, keys=("symbol",), order: str = "bar_ts") -> DataFrame:
    """rows with third: 0, 1 or 2 by the position in a sample cut in three parts of floor(n / 3) rows, the last one with the rest."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    return rows.withColumn("third", F.least(F.floor(i / F.greatest(F.floor(n / 3), F.lit(1))), F.lit(2)).cast("int"))


def cohens_label(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def paired(rows: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    """(keys, n, mean_diff, t, df, cohens_d, effect, p): a paired test of two columns; d by the deviation of the population, p by the normal distribution."""
    diff = F.col(a) - F.col(b)
    d = rows.where(diff.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("s"), F.stddev_pop(diff).alias("sp"))
    t = F.col("mean_diff") / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))
    d = d.withColumn("t", t).withColumn("cohens_d", F.coalesce(F.col("mean_diff") / F.nullif(F.col("sp"), F.lit(0.0)), F.lit(0.0)))
    return d.select(*keys, "n", "mean_diff", "t", (F.col("n") - 1).alias("df"), "cohens_d", cohens_label(F.col("cohens_d")).alias("effect"), (2 * (1 - normal_cdf(F.abs("t")))).alias("p"))


#: Up to so many differences without ties or zeros the signed-rank test is exact.
EXACT_ROWS = 50


def rank_sums(most: int = EXACT_ROWS) -> list[tuple[int, int, float]]:
    """(n, w, share): the share of the 2^n choices of signs whose ranks sum to w or less, up to the middle."""
    out, ways = [], np.ones(1)
    for n in range(1, most + 1):
        ways = np.pad(ways, (0, n)) + np.pad(ways, (n, 0))
        share = np.cumsum(ways) / 2.0**n
        out += [(n, w, float(share[w])) for w in range(n * (n + 1) // 4 + 1)]
    return out


def signed_ranks(rows: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    """(keys, n, statistic, p, exact): Wilcoxon's test of the differences of two columns that aren't 0; the statistic is the lesser sum of ranks, ties share
    their mean rank. Exact for up to 50 different ones, else by the normal distribution with the ties' correction; no differences give 0 and 1."""
    spark, keys = rows.sparkSession, list(keys)
    diff = F.col(a) - F.col(b)
    d = rows.where(diff.isNotNull() & ~F.isnan(diff)).select(*keys, diff.alias("d"))
    # equal sizes are counted before they are ranked
    same = d.groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    up_to = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    used = F.col("size") > 0
    live = F.when(used, F.col("c")).otherwise(0)
    same = same.withColumn("rank", F.sum(live).over(up_to) - (F.col("c") - 1) / 2)
    c = F.col("c").cast("double")
    t = same.groupBy(*keys).agg(
        F.sum(live).alias("n"), F.sum(F.when(used, F.col("rank") * F.col("up")).otherwise(0.0)).alias("plus"), F.sum(F.when(used, c * c * c - c).otherwise(0.0)).alias("ties"),
        F.max(F.when(used, F.col("c")).otherwise(2)).alias("_most"),
    )
    n = F.col("n").cast("double")
    t = t.withColumn("statistic", F.least("plus", n * (n + 1) / 2 - F.col("plus")))
    table = spark.createDataFrame(rank_sums(), "n long, w long, share double")
    t = t.join(F.broadcast(table.withColumnRenamed("n", "_n")), (F.col("n") == F.col("_n")) & (F.col("statistic") == F.col("w")) & (F.col("_most") == 1), "left")
    z = (F.col("statistic") - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    p = F.when(F.col("n") == 0, 1.0).when(F.col("share").isNotNull(), F.least(2 * F.col("share"), F.lit(1.0))).otherwise(2 * (1 - normal_cdf(F.abs(z))))
    return t.select(*keys, "n", "statistic", p.alias("p"), F.col("share").isNotNull().alias("exact"))
