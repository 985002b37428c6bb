"""The registry of queries and their SQL for DuckDB, and the tables they start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B

QUERIES: dict = {}
SQL: dict[str, str] = {}

W = "partition by symbol order by bar_ts"
OHLCV = "arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close, count(*) as volume"
#: hour: hours of five symbols. user: days of a symbol for each user, so that symbols and bars grow with the data.
#: dirty: the same with faults: nulls, turned prices, spikes, repeated rows and times.
BASES = {
    "hour": f"b as (select event_type as symbol, date_trunc('hour', ts) as bar_ts, {OHLCV} from events group by 1, 2)",
    "user": f"b as (select cast(user_id as varchar) as symbol, cast(date_trunc('day', ts) as timestamp) as bar_ts, {OHLCV} from events group by 1, 2)",
}
FAULTS = {
    "open": "case when day(bar_ts) % 7 = 0 then null else open end",
    "high": "case when day(bar_ts) = 9 then low - 1 else high end",
    "low": "case when day(bar_ts) = 11 then -low else low end",
    "close": "case when day(bar_ts) = 13 and volume > 3 then close * 100000 else close end",
    "volume": "case when day(bar_ts) = 15 then -volume when day(bar_ts) = 16 then null else volume end",
}
_dirty = ", ".join(f"{x} as {c}" for c, x in FAULTS.items())
BASES["dirty"] = BASES["user"].replace("b as (", "clean as (", 1) + f", b as (select symbol, bar_ts, {_dirty} from clean union all select symbol, bar_ts, {_dirty} from clean where volume = 3 union all select symbol, bar_ts, open, high, low, close + 1, volume from clean where volume = 4)"


def ntz(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables hold them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars_from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("user", F.col("user_id").cast("string"))
    return B.bars_from_ticks(ticks, "day", "user")


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the bars: each becomes one row or two."""
    clean = user_bars(spark, sf_dir)
    broken = F.struct(*[F.expr(x).alias(c) for c, x in FAULTS.items()])
    shifted = F.struct("open", "high", "low", (F.col("close") + 1).alias("close"), "volume")
    rows = F.when(F.col("volume") == 3, F.array(broken, broken)).when(F.col("volume") == 4, F.array(broken, shifted)).otherwise(F.array(broken))
    return clean.select("symbol", "bar_ts", F.explode(rows).alias("x")).select("symbol", "bar_ts", "x.*")


TABLES = {"hour": hour_bars, "user": user_bars, "dirty": dirty_bars}


def registered(sql: str, base: str = "user", name: str | None = None):
    """Registers f(bars) -> DataFrame as a query beside its SQL, which starts after the table b of the bars."""

    def keep(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: ntz(f(TABLES[base](spark, sf_dir)))
        SQL[name or f.__name__] = f"with recursive {BASES[base]}{sql}"
        return f

    return keep


def rounded(digits: int, zero: float = 0.0, **columns) -> list:
    """Columns or expressions, rounded half away from 0 as the binary product with a power of ten has it, which is what DuckDB does. A zero of -0.0
    leaves negative zeros as they are."""
    out = []
    for n, c in columns.items():
        x = (F.expr(c) if isinstance(c, str) else c) * float(10**digits)
        whole = F.signum(x) * F.floor(F.abs(x) + 0.5)
        out.append((F.when(F.abs(x) < 4e15, whole).otherwise(x) / float(10**digits) + zero).alias(n))  # no negative 0
    return out


def r6(**columns) -> list:
    return rounded(6, **columns)
