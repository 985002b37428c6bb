"""Regimes of a series: segments, persistence, characteristics, separability, interpretation, and performance by regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import back, by_symbol, corr, divided


def runs(rows: DataFrame, state: str = "regime", value: str = "close") -> DataFrame:
    """(symbol, run, state, first_ts, last_ts, n, mean, std) of runs of equal states; std of the population."""
    turn = F.when(F.col(state).eqNullSafe(back(state)), 0).otherwise(1)
    d = rows.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(by_symbol()))
    return d.groupBy("symbol", "run", state).agg(F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def persistence(segments: DataFrame, state: str = "regime", stable: int = 5) -> DataFrame:
    """(symbol, state, n_runs, mean_length, longest, shortest, stable_share) of states."""
    return segments.groupBy("symbol", state).agg(F.count("*").alias("n_runs"), F.avg("n").alias("mean_length"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.avg((F.col("n") >= stable).cast("double")).alias("stable_share"))


def transitions(segments: DataFrame, state: str = "regime") -> DataFrame:
    """(symbol, state, next_state, n, share) of changes from one state to another."""
    d = segments.select("symbol", state, F.lead(state).over(Window.partitionBy("symbol").orderBy("run")).alias("next_state")).where("next_state is not null")
    counts = d.groupBy("symbol", state, "next_state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", state)))


def characteristics(rows: DataFrame, state: str = "regime", value: str = "r") -> DataFrame:
    """(symbol, state, n, share, mean, std, skew, kurtosis, trend): moments of the population, kurtosis in excess, and the size of the correlation of
    neighbours within the state."""
    own = Window.partitionBy("symbol", state).orderBy("bar_ts")
    d = rows.withColumn("_last", F.lag(value).over(own))
    m3 = lambda k: F.avg(F.pow(F.col(value) - F.col("_m"), F.lit(k)))
    d = d.withColumn("_m", F.avg(value).over(Window.partitionBy("symbol", state)))
    out = d.groupBy("symbol", state).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), m3(3).alias("_3"), m3(4).alias("_4"), F.abs(corr(value, "_last")).alias("trend"))
    s = F.nullif("std", F.lit(0.0))
    out = out.withColumns({"skew": F.coalesce(F.col("_3") / F.pow(s, 3), F.lit(0.0)), "kurtosis": F.coalesce(F.col("_4") / F.pow(s, 4) - 3, F.lit(0.0)), "trend": F.coalesce("trend", F.lit(0.0))})
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))).drop("_3", "_4")


def hurst(rows: DataFrame, value: str = "x", most: int = 20) -> DataFrame:
    """(symbol, hurst, reversion): the slope of log deviations of differences over log lags 2 .. least(most, n / 2), and 1 - 2 * it within 0 and 1."""
    lags = list(range(2, most + 1))
    d = rows.withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).withColumns({f"_d{k}": F.col(value) - F.lag(value, k).over(by_symbol()) for k in lags})
    s = d.groupBy("symbol", "_n").agg(*[F.stddev_pop(f"_d{k}").alias(f"_s{k}") for k in lags])
    each = s.select("symbol", "_n", F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"_s{k}").alias("s")) for k in lags])).alias("x")).where((F.col("x.k") <= F.floor(F.col("_n") / 2)) & (F.col("x.s") > 0))
    out = each.groupBy("symbol").agg(F.regr_slope(F.log("x.s"), F.log("x.k")).alias("hurst"))
    return out.withColumn("reversion", F.least(F.greatest(1 - 2 * F.col("hurst"), F.lit(0.0)), F.lit(1.0)))


def separability(rows: DataFrame, state: str = "regime", value: str = "r") -> DataFrame:
    """(symbol, n_states, between, within, separability, consistency, stability): variance of the states' means by that and the variance within, 1 less the
    entropy of the states' shares, and 1 less twice the share of changes."""
    by = rows.groupBy("symbol", state).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    changes = rows.withColumn("_c", (F.col(state) != back(state)).cast("int")).groupBy("symbol").agg(F.sum("_c").alias("changes"), F.count("*").alias("rows"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))
    d = by.withColumn("h", -p * F.log(p)).groupBy("symbol").agg(F.count("*").alias("n_states"), F.var_pop("m").alias("between"), F.avg("v").alias("within"), F.sum("h").alias("h"))
    d = d.join(changes, "symbol")
    return d.select(
        "symbol", "n_states", "between", "within", F.coalesce(F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0)), F.lit(0.0)).alias("separability"),
        F.when(F.col("n_states") > 1, 1 - F.col("h") / F.log(F.col("n_states").cast("double"))).otherwise(1.0).alias("consistency"), (1 - F.least(F.lit(1.0), 2 * F.col("changes") / F.col("rows"))).alias("stability"),
    )


def state_importance(rows: DataFrame, columns, state: str = "regime") -> DataFrame:
    """(symbol, state, name, importance, place): half the coefficient of variation and half the size of the mean, as shares of a state's total."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    d = rows.select("symbol", state, pairs.alias("x")).groupBy("symbol", state, F.col("x.name").alias("name")).agg(F.avg("x.v").alias("m"), F.stddev_pop("x.v").alias("s"))
    d = d.withColumn("raw", 0.5 * F.coalesce(F.col("s") / F.nullif(F.abs("m"), F.lit(0.0)), F.lit(0.0)) + 0.5 * F.abs("m"))
    w = Window.partitionBy("symbol", state)
    return d.withColumn("importance", F.coalesce(F.col("raw") / F.nullif(F.sum("raw").over(w), F.lit(0.0)), F.lit(0.0))).withColumn("place", F.row_number().over(w.orderBy(F.desc("importance"), "name"))).drop("m", "s", "raw")


def regime_type(std: Column, trend: Column, reversion: Column) -> Column:
    return F.when(std > 0.5, "high volatility").when(trend > 0.6, "trending").when(reversion > 0.6, "mean reverting").otherwise("mixed")


def market_condition(mean: Column) -> Column:
    return F.when(mean > 0.3, "bull").when(mean < -0.3, "bear").otherwise("sideways")


def risk_level(std: Column) -> Column:
    return F.when(std > 0.7, "high").when(std > 0.3, "medium").otherwise("low")


def filled_regimes(equity: DataFrame, regimes: DataFrame, state: str = "regime") -> DataFrame:
    """equity with the regime of its time: the last one known, before the first one the first."""
    d = equity.join(regimes.select("symbol", "bar_ts", state), ["symbol", "bar_ts"], "left")
    w = by_symbol()
    return d.withColumn(state, F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(state, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def performance_by(rows: DataFrame, state: str = "regime", value: str = "equity", per_year: float = 288 * 365.0) -> DataFrame:
    """(symbol, state, n, share, total_return, volatility, sharpe): returns are taken between neighbours within the state."""
    own = Window.partitionBy("symbol", state).orderBy("bar_ts")
    d = rows.withColumn("_r", F.col(value) / F.nullif(F.lag(value).over(own), F.lit(0.0)) - 1)
    out = d.groupBy("symbol", state).agg(F.count("*").alias("n"), (divided(F.max_by(value, "bar_ts"), F.min_by(value, "bar_ts")) - 1).alias("total_return"), F.stddev_samp("_r").alias("_s"), F.avg("_r").alias("_m"))
    out = out.withColumns({"volatility": F.col("_s") * per_year**0.5, "sharpe": F.coalesce(F.col("_m") / F.nullif("_s", F.lit(0.0)) * per_year**0.5, F.lit(0.0)), "share": F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))})
    return out.drop("_s", "_m")


def summary(by: DataFrame, state: str = "regime") -> DataFrame:
    """(symbol, best, worst, mean_return): the states of largest and smallest return, and the mean weighted by time."""
    key = F.struct("total_return", state)
    return by.groupBy("symbol").agg(F.max_by(state, key).alias("best"), F.min_by(state, key).alias("worst"), F.sum(F.col("total_return") * F.col("share")).alias("mean_return"))


def near_events(changes: DataFrame, events: DataFrame, within: int = 5) -> DataFrame:
    """changes(symbol, i) matched to events(symbol, event, at) at most within positions off: an equal join on buckets of the position, each event in all the
    buckets that it may meet."""
    width = 2 * within + 1
    e = events.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at") - within) / width), F.floor((F.col("at") + within) / width))))
    c = changes.withColumn("_b", F.floor(F.col("i") / width))
    return c.join(e, ["symbol", "_b"]).where(F.abs(F.col("i") - F.col("at")) <= within).drop("_b")


def against(rows: DataFrame, benchmark: DataFrame, per_year: float = 252.0) -> DataFrame:
    """rows(symbol, bar_ts, v) and benchmark(bar_ts, w): beta, alpha, correlation, tracking error and information ratio of the returns at common times."""
    d = rows.join(benchmark, "bar_ts").withColumns({"a": F.col("v") / F.nullif(back("v"), F.lit(0.0)) - 1, "m": F.col("w") / F.nullif(back("w"), F.lit(0.0)) - 1}).where("a is not null and m is not null")
    out = d.groupBy("symbol").agg(F.count("*").alias("n"), F.covar_pop("a", "m").alias("c"), F.var_pop("m").alias("vm"), F.avg("a").alias("ma"), F.avg("m").alias("mm"), corr("a", "m").alias("corr"), F.stddev_samp(F.col("a") - F.col("m")).alias("te"))
    beta = F.col("c") / F.nullif("vm", F.lit(0.0))
    out = out.withColumn("beta", beta).withColumn("alpha", (F.col("ma") - F.col("beta") * F.col("mm")) * per_year)
    return out.select("symbol", "n", "beta", "alpha", "corr", (F.col("te") * per_year**0.5).alias("tracking_error"), ((F.col("ma") - F.col("mm")) / F.nullif("te", F.lit(0.0)) * per_year**0.5).alias("information_ratio"))
