"""The ten features of a bar, their checks, the signals and vectors made of them, and snapshots of labelled features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.recurrences import recurrent

NAMES = ("rsi", "sma_20", "ema_20", "std_20", "zscore_20", "momentum", "wavetrend_1", "wavetrend_2", "cci", "adx")


def features(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, bar_ts, open to volume, the features NAMES): frames in the engine, and the recurrences of a symbol in one pass beside them."""
    rec = recurrent(bars, n).select("symbol", "bar_ts", "rsi", F.col("ema").alias("ema_20"), F.col("wt1").alias("wavetrend_1"), F.col("wt2").alias("wavetrend_2"), F.nanvl("adx", F.lit(None)).alias("adx"))
    own = B.cci(bars, n).withColumns({"sma_20": B.sma(n), "std_20": B.std(n), "zscore_20": B.zscore(n), "momentum": B.momentum()})
    return own.join(rec, ["symbol", "bar_ts"]).select("symbol", "bar_ts", "open", "high", "low", "close", "volume", *NAMES)


def levels(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, bar_ts, std_20, zscore_20, momentum) of features, without its recurrences and with deviations in the order of bars."""
    d = bars.select("symbol", "bar_ts", "close", B.sma(n).alias("sma_20"), B.std_in_order(n).alias("std_20"), B.momentum().alias("momentum"))
    return d.select("symbol", "bar_ts", "std_20", ((F.col("close") - F.col("sma_20")) / F.nullif("std_20", F.lit(0.0))).alias("zscore_20"), "momentum")


#: What holds of a sound feature; null ones are sound.
RANGES = {
    "rsi": "rsi between 0 and 100",
    "sma_20": "sma_20 > 0",
    "ema_20": "ema_20 > 0",
    "std_20": "std_20 >= 0",
    "zscore_20": "abs(zscore_20) <= 10",
    "momentum": "abs(momentum) <= 1",
    "cci": "abs(cci) <= 1000",
    "adx": "adx between -0.001 and 100.001",
}


def out_of_range(feats: DataFrame) -> DataFrame:
    """(symbol, bar_ts, faults): the names of the features of a bar that are out of their range."""
    return feats.select("symbol", "bar_ts", F.array_compact(F.array(*[F.when(~F.expr(x), F.lit(n)) for n, x in RANGES.items()])).alias("faults"))


def signals(feats: DataFrame, mr_least: float = 0.1, momentum_least: float = 0.01) -> DataFrame:
    """(symbol, bar_ts, s_mr, s_tsmom): mean reversion and momentum, 0 within their dead bands."""
    mr = F.when(F.col("zscore_20").isNotNull() & F.col("std_20").isNotNull(), -F.col("zscore_20") / F.greatest("std_20", F.lit(1e-8)))

    def banded(x: Column, least: float) -> Column:
        return F.when(F.abs(x) < least, 0.0).otherwise(x)

    return feats.select("symbol", "bar_ts", banded(mr, mr_least).alias("s_mr"), banded(F.col("momentum"), momentum_least).alias("s_tsmom"))


def vector(fifth: str = "wavetrend_2", defaults: bool = False) -> Column:
    """The five components of a neighbour search as floats: null if one is, or with defaults for missing ones."""
    names = ("rsi", "wavetrend_1", "cci", "adx", fifth)
    if defaults:
        return F.array(*[F.coalesce(F.col(c), F.lit(v)) for c, v in zip(names, (50.0, 0.0, 0.0, 25.0, 0.0))]).cast("array<float>")
    known = F.lit(True)
    for c in names:
        known &= F.col(c).isNotNull()
    return F.when(known, F.array(*names).cast("array<float>"))


def snapshot(bars: DataFrame, horizon: int = 4, buy: float = 0.02, sell: float = -0.02, columns=("sma_20", "std_20", "momentum"), n: int = 20) -> DataFrame:
    """Distinct bars of symbols with at least horizon + 20 of them, with features, future_return, label and label_confidence: how far
    the return is from the threshold of its label, for Hold from the nearer one."""
    d = bars.dropDuplicates()
    many = F.count("*").over(Window.partitionBy("symbol")) >= horizon + 20
    made = {"sma_20": B.sma(n), "std_20": B.std(n), "momentum": B.momentum(), "zscore_20": B.zscore(n)}
    d = d.withColumns({c: made[c] for c in sorted(set(columns))} | {"future_return": B.future_return(horizon), "_many": many}).where("_many").drop("_many")
    r = F.col("future_return")
    d = d.withColumn("label", B.label_of(r, buy, sell))
    near = F.when(F.col("label") == "Buy", F.abs(r - buy)).when(F.col("label") == "Sell", F.abs(r - sell)).when(F.col("label") == "Hold", F.least(F.abs(r - buy), F.abs(r - sell)))
    return d.withColumn("label_confidence", near)


def snapshot_info(snap: DataFrame, horizon: int = 4, most: float = 0.7) -> DataFrame:
    """One row: id, n, n_labelled, the counts and shares of labels, and whether no label has more than a share of all."""
    label = F.col("label")
    d = snap.agg(
        F.count("*").alias("n"), F.count(label).alias("n_labelled"), *[F.count_if(label == x).alias(f"n_{x.lower()}") for x in ("Buy", "Sell", "Hold")], F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts")
    )
    shares = {f"share_{x}": F.col(f"n_{x}") / F.nullif("n_labelled", F.lit(0)) for x in ("buy", "sell", "hold")}
    d = d.withColumns(shares).withColumn("balanced", (F.col("n_labelled") > 0) & (F.greatest(*shares) <= most))
    return d.withColumn("id", F.format_string("snapshot_h%d_%s_%s", F.lit(horizon), F.date_format("first_ts", "yyyyMMdd"), F.date_format("last_ts", "yyyyMMdd")))


def training_rows(bars: DataFrame, horizon: int = 4, threshold: float = 0.001) -> DataFrame:
    """(symbol, bar_ts, bar_index, move, label): the direction of the move horizon bars ahead, neutral within a threshold."""
    move = B.future_return(horizon)
    d = bars.select("symbol", "bar_ts", (F.row_number().over(B.by_symbol()) - 1).alias("bar_index"), move.alias("move"))
    return d.where("move is not null").withColumn("label", F.when(F.col("move") > threshold, 1).when(F.col("move") < -threshold, -1).otherwise(0))


def research(bars: DataFrame) -> DataFrame:
    """The whole set of research features: returns, rolling statistics of 5, 10 and 20, rates of change, volatility, range and lags;
    null until a frame is full."""
    over = lambda n=1: F.nullif(B.back("close", n), F.lit(0.0))
    r = bars.withColumns({"return_1": F.col("close") / over() - 1, "log_return": F.log(F.col("close") / over())})
    out = {}
    for n in (5, 10, 20):
        full = lambda x, n=n: B.when_full(x, n)
        out |= {f"mean_{n}": full(B.sma(n)), f"std_{n}": full(B.std(n)), f"z_{n}": full((F.col("close") - B.sma(n)) / F.nullif(B.std(n), F.lit(0.0)))}
    for n in (5, 10):
        out |= {f"roc_{n}": F.col("close") / over(n) - 1, f"momentum_{n}": F.col("close") - B.back("close", n)}
    for n in (10, 20):
        out[f"volatility_{n}"] = B.when_full(B.std(n, "return_1"), n, "return_1")
    out["range_10"] = B.when_full(F.max("close").over(B.last(10)) - F.min("close").over(B.last(10)), 10)
    return r.withColumns(out | {f"lag_{k}": B.back("close", k) for k in (1, 2, 3)})


def simplified(bars: DataFrame, n: int = 14) -> DataFrame:
    """Rolling versions of all indicators in frames of n bars, null until one is full: relative strength by mean gain and loss, an average restarted
    in each frame, deviation of the population, CCI about the current mean within 500, movement over range, and wave trend as percent of the mean."""
    prev = {c: B.back(c) for c in ("high", "low", "close")}
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = bars.withColumns({"_move": F.col("close") - prev["close"], "_tp": tp, "_tr": B.true_range(), "_up": F.col("high") - prev["high"], "_down": prev["low"] - F.col("low")})
    w, inner = B.last(n), B.by_symbol().rowsBetween(-(n - 2), 0)
    gain, loss = (F.avg(F.greatest(F.col("_move") * s, F.lit(0.0))).over(inner) for s in (1, -1))
    alpha = 2 / (n + 1)
    ema = F.aggregate(F.slice(F.collect_list("close").over(w), 2, n), F.element_at(F.collect_list("close").over(w), 1), lambda a, x: (1 - alpha) * a + alpha * x)
    mean = F.avg("_tp").over(w)
    dev = F.aggregate(F.collect_list("_tp").over(w), F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    plus = F.sum(F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)).over(inner)
    tr = F.sum("_tr").over(inner)
    wt = (F.col("_tp") - mean) / F.nullif(mean, F.lit(0.0)) * 100
    out = {
        "rsi": F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))), "sma": B.sma(n), "ema": ema, "std": F.stddev_pop("close").over(w),
        "cci": F.when(dev > 0, F.least(F.greatest((F.col("_tp") - mean) / F.nullif(0.015 * dev, F.lit(0.0)), F.lit(-500.0)), F.lit(500.0))).otherwise(0.0),
        "adx": F.when(tr > 0, plus / F.nullif(tr, F.lit(0.0)) * 100).otherwise(0.0), "wt1": wt, "wt2": wt * 0.8,
    }
    full = F.count("*").over(w) == n
    return d.select("symbol", "bar_ts", *[F.when(full, x).alias(c) for c, x in out.items()])


def smoothed(bars: DataFrame, c: str = "close") -> DataFrame:
    """bars with smooth: of each five bars around, the value of the parabola that fits them best; at a symbol's ends, of the parabola through its
    first or last five bars. Shorter series are left as they are."""
    at = lambda k: F.lag(c, -k).over(B.by_symbol())
    weights = {0: (-3, 12, 17, 12, -3), -2: (31, 9, -3, -5, 3), -1: (9, 13, 12, 6, -5), 1: (-5, 6, 12, 13, 9), 2: (3, -5, -3, 9, 31)}  # of the place within five bars, over 35
    i, n = F.row_number().over(B.by_symbol()), F.count("*").over(Window.partitionBy("symbol"))
    place = F.when(i == 1, -2).when(i == 2, -1).when(i == n, 2).when(i == n - 1, 1).otherwise(0)
    fits = F.lit(None).cast("double")
    for p, w in weights.items():
        fits = F.coalesce(F.when(place == p, sum((at(k - 2 - p) * x for k, x in enumerate(w)), F.lit(0.0)) / 35), fits)
    return bars.withColumn("smooth", F.when(n >= 5, fits).otherwise(F.col(c)))
