"""Tables made up for tests: bars under changing regimes, edge cases, and rows with known faults. Each row is made from its number and a seed alone, so
tables of any size are made where they are needed and come out the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGIMES = {"normal": (0.0, 0.01), "trend": (0.002, 0.008), "range": (0.0, 0.004), "crisis": (-0.004, 0.04)}


def uniform(seed: int, *on) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*on, F.lit(seed)), 11) / float(1 << 53)


def normal(seed: int, *on) -> Column:
    u, v = F.greatest(uniform(seed, *on), F.lit(1e-12)), uniform(seed + 1, *on)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def ohlcv(spark: SparkSession, n: int, symbols: int = 1, seed: int = 42, start: int = 1_700_000_000, step: int = 300, length: int = 100) -> DataFrame:
    """(symbol, timestamp, open, high, low, close, volume): n bars of each symbol; the regime changes each length bars. Opens are within a thousandth of the
    close, wicks up to two."""
    d = spark.range(n * symbols).select((F.col("id") % symbols).cast("string").alias("symbol"), F.floor(F.col("id") / symbols).alias("i"))
    kind = (F.xxhash64("symbol", F.floor(F.col("i") / length), F.lit(seed)) % 4 + 4) % 4
    drift, vol = F.lit(0.0), F.lit(0.0)
    for k, (m, s) in enumerate(REGIMES.values()):
        drift, vol = F.when(kind == k, m).otherwise(drift), F.when(kind == k, s).otherwise(vol)
    d = d.withColumn("move", drift + vol * normal(seed, "symbol", "i"))
    w = Window.partitionBy("symbol").orderBy("i")
    d = d.withColumn("close", 100 * F.exp(F.sum("move").over(w)))
    d = d.withColumn("open", F.col("close") * (1 + 0.002 * (uniform(seed + 2, "symbol", "i") - 0.5)))
    high = F.greatest("open", "close") * (1 + 0.002 * uniform(seed + 3, "symbol", "i"))
    low = F.least("open", "close") * (1 - 0.002 * uniform(seed + 4, "symbol", "i"))
    return d.select("symbol", (F.lit(start) + F.col("i") * step).cast("long").alias("timestamp"), "open", high.alias("high"), low.alias("low"), "close", F.floor(1000 * (1 + uniform(seed + 5, "symbol", "i"))).cast("double").alias("volume"))


def edge_cases(spark: SparkSession, start: int = 1_700_000_000, step: int = 300) -> DataFrame:
    """Sound but extreme bars: spikes, no volume, flat prices, tiny and vast prices, a flash crash."""
    closes = [100.0, 150.0, 100.0, 100.0, 100.0, 0.001, 999_000.0, 100.0, 50.0, 100.0]
    rows = [("edge", start + step * i, c, c * (1.5 if i == 1 else 1.0), c * (0.5 if i == 8 else 1.0), c, 0.0 if i in (2, 3) else 1000.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double")


def faulty(spark: SparkSession) -> DataFrame:
    """Rows that each break rules, with what they break."""
    rows = [
        ("bad", 1000, 1.0, 0.5, 2.0, 1.5, 1.0, ["range", "bracket"]), ("bad", 2000, -1.0, 2.0, 0.5, 1.5, 1.0, ["price", "level"][:1]), ("bad", 3000, 1.0, 2.0, 0.5, 1.5, -1.0, ["volume"]),
        ("bad", 4000, 1.0, 1.2, 0.5, 1.5, 1.0, ["bracket"]), ("bad", 5000, 1.0, 2.0, 0.5, 1.5, 1.0, []), ("bad", 6000, 2e6, 3e6, 1e6, 2e6, 1.0, ["level"]),
    ]
    return spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double, breaks array<string>")


def signals(spark: SparkSession, n: int = 1000, columns: int = 3, seed: int = 42) -> DataFrame:
    """(symbol, bar_ts, s_0, s_1, ...): slowly moving signals within -1 .. 1."""
    d = spark.range(n).select(F.lit("sample").alias("symbol"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 300).alias("bar_ts"), "id")
    return d.select("symbol", "bar_ts", *[F.greatest(F.least(0.7 * F.sin(F.col("id") / (10 + 5 * k)) + 0.1 * normal(seed + 10 * k, "id"), F.lit(1.0)), F.lit(-1.0)).alias(f"s_{k}") for k in range(columns)])


def suite(spark: SparkSession, path: str, seed: int = 42) -> dict[str, str]:
    """Several tables on disk."""
    made = {"normal": ohlcv(spark, 500, 2, seed), "edge": edge_cases(spark), "faulty": faulty(spark), "signals": signals(spark, 300)}
    for name, d in made.items():
        d.write.mode("overwrite").parquet(f"{path}/{name}")
    return {n: f"{path}/{n}" for n in made}
