"""Checks of a table of bars: nulls, duplicates, outliers, times, rules, anomalies, scores and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import back, corr

NUMERIC = ("open", "high", "low", "close", "volume")


def stacked(df: DataFrame, columns=NUMERIC, keep=()) -> DataFrame:
    """(keep, name, value): a row for each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*")


def missing(df: DataFrame, columns=NUMERIC, warn: float = 0.01, fail: float = 0.05) -> DataFrame:
    """(name, n_null, share, status) of each column."""
    got = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = stacked(got, columns, ["n"]).withColumn("share", F.col("value") / F.col("n"))
    status = F.when(F.col("share") > fail, "Fail").when(F.col("share") > warn, "Warn").otherwise("Pass")
    return rows.select("name", F.col("value").cast("long").alias("n_null"), "share", status.alias("status"))


def duplicates(df: DataFrame) -> DataFrame:
    """(n, n_distinct, n_duplicate): equal rows are counted before they are shuffled."""
    seen = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return seen.agg(F.sum("_n").alias("n"), F.count("*").alias("n_distinct"), (F.sum("_n") - F.count("*")).alias("n_duplicate"))


def floor_quantiles(df: DataFrame, shares: dict[str, Column], value: str = "value", keys=("name",)) -> DataFrame:
    """(keys, n, names of shares...): the value at an index from 0 of a group's sorted values, by a running count of distinct
    values, not by a list of all of them. shares: name -> index as an expression of n."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = known.withColumn("_to", F.sum("_k").over(w)).withColumn("n", F.sum("_k").over(Window.partitionBy(*keys)))
    return upto.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("_to") > i, F.col(value))).alias(c) for c, i in shares.items()])


def outliers(df: DataFrame, columns=NUMERIC, width: float = 1.5, deviations: float = 3.0) -> DataFrame:
    """(name, n, q1, q3, n_iqr, mean, std, n_z): quartiles at sorted[n / 4] and sorted[3 n / 4], and deviations of the population."""
    rows = stacked(df, columns)
    q = floor_quantiles(rows, {"q1": F.floor(F.col("n") / 4), "q3": F.floor(3 * F.col("n") / 4)})
    z = rows.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    bounds = F.broadcast(q.join(z, "name"))  # a row for each column
    iqr = F.col("q3") - F.col("q1")
    out = rows.join(bounds, "name").groupBy("name", "n", "q1", "q3", "mean", "std")
    far = (F.col("value") < F.col("q1") - width * iqr) | (F.col("value") > F.col("q3") + width * iqr)
    return out.agg(F.count_if(far).alias("n_iqr"), F.count_if((F.col("std") > 0) & (F.abs(F.col("value") - F.col("mean")) / F.col("std") > deviations)).alias("n_z"))


def times(df: DataFrame, expected: int = 86_400) -> DataFrame:
    """(symbol, n, n_repeated, n_gap, shortest, longest, mean_step, n_irregular, regular) of the steps between times in seconds."""
    d = df.select("symbol", (F.unix_timestamp("bar_ts") - F.unix_timestamp(back("bar_ts"))).alias("step"))
    out = d.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("step") == 0).alias("n_repeated"), F.count_if(F.col("step") > 3 * expected).alias("n_gap"), F.min("step").alias("shortest"), F.max("step").alias("longest"), F.avg("step").alias("mean_step"), F.count_if(F.col("step") != expected).alias("n_irregular"))
    return out.withColumn("regular", F.col("n_irregular") == 0)


def modal_step(df: DataFrame, default: int = 300, least: int = 60, most: int = 86_400) -> DataFrame:
    """(symbol, step): the most frequent step in seconds, the smallest of equals; the default where there is none or it is out of bounds."""
    d = df.select("symbol", (F.unix_timestamp("bar_ts") - F.unix_timestamp(back("bar_ts"))).alias("step"))
    counts = d.where("step is not null").groupBy("symbol", "step").agg(F.count("*").alias("n"))
    mode = counts.groupBy("symbol").agg(F.min_by("step", F.struct(-F.col("n"), "step")).alias("step"))
    every = d.select("symbol").distinct().join(mode, "symbol", "left")
    return every.select("symbol", F.when(F.col("step").between(least, most), F.col("step")).otherwise(default).alias("step"))


def gaps(df: DataFrame, factor: float = 2.0) -> DataFrame:
    """(symbol, gap_start, gap_end, seconds): steps over factor times the symbol's modal one."""
    d = df.select("symbol", back("bar_ts").alias("gap_start"), F.col("bar_ts").alias("gap_end")).where("gap_start is not null")
    d = d.withColumn("seconds", F.unix_timestamp("gap_end") - F.unix_timestamp("gap_start"))
    return d.join(modal_step(df), "symbol").where(F.col("seconds") > factor * F.col("step")).drop("step")


#: Rules of a bar, as expressions that are true of sound bars. last_ts: the time before.
RULES = {
    "time": "unix_timestamp(bar_ts) > 0",
    "price": "open > 0 and high > 0 and low > 0 and close > 0",
    "range": "high >= low",
    "bracket": "high >= greatest(open, close) and low <= least(open, close)",
    "volume": "volume >= 0",
    "level": "(open + high + low + close) / 4 between 0.0001 and 1000000",
    "order": "last_ts is null or bar_ts > last_ts",
}


def broken(df: DataFrame) -> DataFrame:
    """(symbol, rule, n): bars by the rule they break, nulls break theirs; the rule `none` counts sound bars. Bars of equal times are ordered by their close. One pass."""
    d = df.withColumn("last_ts", F.lag("bar_ts").over(Window.partitionBy("symbol").orderBy("bar_ts", "close")))
    names = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(x), F.lit(False)), F.lit(n)) for n, x in RULES.items()]))
    return d.select("symbol", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("none")))).alias("rule")).groupBy("symbol", "rule").agg(F.count("*").alias("n"))


def repeated_times(df: DataFrame) -> DataFrame:
    """(symbol, n_repeated): rows beyond the first of their time."""
    return df.groupBy("symbol", "bar_ts").agg(F.count("*").alias("n")).where("n > 1").groupBy("symbol").agg(F.sum(F.col("n") - 1).alias("n_repeated"))


def market_anomalies(df: DataFrame, jump: float = 0.1, volume: float = 10.0) -> DataFrame:
    """(symbol, n_jump, median_volume, n_volume): steps of the close beyond a share, and volumes beyond a multiple of the median."""
    d = df.select("symbol", "volume", F.abs(F.col("close") / F.nullif(back("close"), F.lit(0.0)) - 1).alias("move"))
    mid = floor_quantiles(d.withColumn("value", F.col("volume").cast("double")), {"lo": F.floor((F.col("n") - 1) / 2), "hi": F.floor(F.col("n") / 2)}, keys=("symbol",))
    d = d.join(mid.select("symbol", ((F.col("lo") + F.col("hi")) / 2).alias("median_volume")), "symbol")
    return d.groupBy("symbol", "median_volume").agg(F.count_if(F.col("move") > jump).alias("n_jump"), F.count_if(F.col("volume") > volume * F.col("median_volume")).alias("n_volume"))


def signal_anomalies(df: DataFrame, columns, deviations: float = 3.0, most_null: float = 0.2) -> DataFrame:
    """(name, n_far, constant, sparse) of signal columns."""
    rows = stacked(df, columns)
    facts = rows.groupBy("name").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), (F.count_if(F.col("value").isNull()) / F.count("*") > most_null).alias("sparse"))
    got = rows.join(F.broadcast(facts), "name").groupBy("name", "s", "sparse").agg(F.count_if(F.abs(F.col("value") - F.col("m")) > deviations * F.col("s")).alias("n_far"))
    return got.select("name", "n_far", (F.coalesce("s", F.lit(0.0)) == 0).alias("constant"), "sparse")


def score(mean_missing: Column, n_anomalies: Column, n_gaps: Column) -> Column:
    """1 less 0.3 at most for missing values, 0.3 for anomalies and 0.2 for gaps, not below 0."""
    return F.greatest(F.lit(0.0), 1 - F.least(mean_missing, F.lit(0.3)) - F.least(0.05 * n_anomalies, F.lit(0.3)) - F.least(0.02 * n_gaps, F.lit(0.2)))


def metrics(df: DataFrame, columns=NUMERIC) -> DataFrame:
    """(name, n, n_null, n_infinite, constant, low, high, cv, unique_share) of columns."""
    v = F.col("value")
    out = stacked(df, columns).groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.abs(v) == float("inf")).alias("n_infinite"), F.min(v).alias("low"), F.max(v).alias("high"),
        (F.stddev_samp(v) / F.nullif(F.abs(F.avg(v)), F.lit(0.0))).alias("cv"), (F.count_distinct(v) / F.count("*")).alias("unique_share"),
    )
    return out.withColumn("constant", F.col("low") == F.col("high"))


def moments(df: DataFrame, columns=NUMERIC) -> DataFrame:
    """(name, n, mean, std, skew, kurtosis): of samples, corrected for bias, kurtosis in excess."""
    v, n = F.col("value"), F.col("n")
    out = stacked(df, columns).groupBy("name").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurtosis = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return out.select("name", "n", "mean", "std", skew.alias("skew"), kurtosis.alias("kurtosis"))


def correlations(df: DataFrame, columns=NUMERIC) -> DataFrame:
    """(a, b, r) of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = df.agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return got.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def importance(df: DataFrame, columns) -> DataFrame:
    """(name, variance, mean_size, nonzero, top_corr) of features; the last is the largest absolute correlation with another."""
    facts = stacked(df, columns).groupBy("name").agg(F.var_samp("value").alias("variance"), F.avg(F.abs("value")).alias("mean_size"), F.avg((F.col("value") != 0).cast("double")).alias("nonzero"))
    c = correlations(df, columns)
    each = c.select(F.col("a").alias("name"), "r").unionByName(c.select(F.col("b").alias("name"), "r"))
    return facts.join(each.groupBy("name").agg(F.max(F.abs("r")).alias("top_corr")), "name")


def worst(*status: Column) -> Column:
    """The worst of Pass, Warn and Fail."""
    code = reduce(lambda a, b: F.greatest(a, b), [F.when(s == "Fail", 2).when(s == "Warn", 1).otherwise(0) for s in status] + [F.lit(0)])
    return F.when(code == 2, "Fail").when(code == 1, "Warn").otherwise("Pass")


def report(df: DataFrame) -> DataFrame:
    """One row: n, n_null, n_duplicate, n_repeated, n_outlier, missing_status, duplicate_status, time_status, outlier_status, status."""
    n = df.agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"))
    nulls = missing(df).agg(F.sum("n_null").alias("n_null"))
    dup = duplicates(df).select("n_duplicate")
    rep = times(df).agg(F.sum("n_repeated").alias("n_repeated"))
    far = outliers(df).agg(F.sum("n_iqr").alias("n_outlier"))
    out = n.join(nulls).join(dup).join(rep).join(far)  # a row each
    share = F.col("n_null") / (F.col("n") * len(NUMERIC))
    out = out.withColumns({
        "missing_status": F.when(share > 0.05, "Fail").when(share > 0.01, "Warn").otherwise("Pass"),
        "duplicate_status": F.when(F.col("n_duplicate") / F.col("n") > 0.05, "Fail").when(F.col("n_duplicate") > 0, "Warn").otherwise("Pass"),
        "time_status": F.when(F.col("n_repeated") > 0, "Warn").otherwise("Pass"),
        "outlier_status": F.when(F.col("n_outlier") / (F.col("n") * len(NUMERIC)) > 0.1, "Fail").when(F.col("n_outlier") > 0, "Warn").otherwise("Pass"),
    })
    return out.withColumn("status", worst(*[F.col(c) for c in out.columns if c.endswith("_status")]))


