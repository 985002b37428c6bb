"""Reading and writing bars, signals and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features as F_
from tidemark.operators.joins import aligned, combined
from tidemark.sources.storage import files_of

OHLCV = "symbol string, timestamp long, open double, high double, low double, close double, volume double"
REQUIRED = ("timestamp", "open", "high", "low", "close", "volume")


def read(spark: SparkSession, path: str, schema: str = OHLCV) -> DataFrame:
    """Bars from CSV, JSON lines or Parquet, by suffix; anything without a suffix is a Parquet folder, partitioned or not."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix == "csv":
        head = spark.read.option("header", True).csv(path).columns
        fields = [f.strip() for f in schema.split(",") if f.split()[0] in head]
        return require(spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(sorted(fields, key=lambda f: head.index(f.split()[0])))).csv(path))
    if suffix in ("json", "jsonl"):
        return require(spark.read.schema(schema).json(path))
    return require(spark.read.parquet(path))


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def timed(df: DataFrame) -> DataFrame:
    """Epoch seconds become bar_ts."""
    return df.withColumn("bar_ts", F.timestamp_seconds("timestamp")).drop("timestamp")


def between(df: DataFrame, first, last, ts: str = "bar_ts") -> DataFrame:
    """Rows from first to last, both with; either may be None."""
    df = df.where(F.col(ts) >= F.lit(first)) if first is not None else df
    return df.where(F.col(ts) <= F.lit(last)) if last is not None else df


def not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def frame(spark: SparkSession, rows) -> DataFrame:
    """Rows (symbol, timestamp, open, high, low, close, volume) of this process as a table."""
    return spark.createDataFrame(rows, OHLCV)


def typed(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Whole numbers of time and numbers of all else; a null is an error when the rows are read."""
    kinds = {c: "long" if c == "timestamp" else "double" for c in columns}
    whole = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast(k)).otherwise(F.col(c).cast(k)).alias(c) for c, k in kinds.items()]
    return require(df, columns).select(*[c for c in df.columns if c not in columns], *whole)


def load(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Bars by suffix, the first max_rows of them by time."""
    df = read(spark, path)
    return df if max_rows is None else df.orderBy("timestamp").limit(max_rows)


def write_partitioned(df: DataFrame, path: str, interval: str, kind: str = "ohlcv") -> None:
    """{kind}/symbol=/date=/interval= folders, dated by the bar; rows of a folder are brought to one task each before they are written. Folders that
    get no row stay as they are."""
    d = df.withColumn("date", F.to_date("bar_ts")).withColumn("interval", F.lit(interval))
    d.repartition("symbol", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "date", "interval").parquet(f"{path.rstrip('/')}/{kind}")


def read_partitioned(spark: SparkSession, path: str, kind: str = "ohlcv", symbols: list[str] | None = None, first=None, last=None, interval: str | None = None) -> DataFrame:
    """Only the folders of the symbols, days and interval are read."""
    schema = {"ohlcv": "open double, high double, low double, close double, volume long", "signals": "s_mr double, s_tsmom double"}.get(kind)
    base = f"{path.rstrip('/')}/{kind}"
    if schema is None:
        df = spark.read.parquet(base).withColumn("symbol", F.col("symbol").cast("string"))
    else:
        df = spark.read.schema(f"bar_ts timestamp, {schema}, symbol string, date date, interval string").parquet(base)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
    if interval is not None:
        df = df.where(F.col("interval") == interval)
    df = df.where(F.col("date") >= F.lit(first).cast("date")) if first is not None else df
    return df.where(F.col("date") <= F.lit(last).cast("date")) if last is not None else df


def is_partitioned(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds folders named symbol=."""
    fs, p = files_of(spark, path)
    return fs.exists(p) and any(x.isDirectory() and x.getPath().getName().startswith("symbol=") for x in fs.listStatus(p))


def read_flat(spark: SparkSession, path: str, kind: str, symbols: list[str] | None = None, first=None, last=None) -> DataFrame:
    """All files *kind*.parquet of a folder."""
    df = spark.read.option("mergeSchema", True).parquet(f"{path.rstrip('/')}/*{kind}*.parquet")
    df = df.where(F.col("symbol").isin(*symbols)) if symbols is not None else df
    return between(df, first, last) if "bar_ts" in df.columns else df


def load_kind(spark: SparkSession, path: str, kind: str, symbols: list[str] | None = None, first=None, last=None) -> DataFrame:
    """signals, features or ohlcv of a folder of either layout."""
    if is_partitioned(spark, f"{path.rstrip('/')}/{kind}"):
        return read_partitioned(spark, path, kind, symbols, first, last)
    return read_flat(spark, path, kind, symbols, first, last)


def load_combined(spark: SparkSession, path: str, symbols: list[str] | None = None, first=None, last=None) -> tuple[DataFrame, DataFrame]:
    """Signals and bars, cut to their common symbols and times."""
    return aligned(load_kind(spark, path, "signals", symbols, first, last), load_kind(spark, path, "ohlcv", symbols, first, last))


def load_outputs(spark: SparkSession, path: str, kinds=("features", "signals", "ohlcv")) -> DataFrame:
    """All the kinds that are there, side by side by symbol and time."""
    found = {}
    for k in kinds:
        fs, p = files_of(spark, f"{path.rstrip('/')}/{k}")
        if fs.exists(p):
            d = load_kind(spark, path, k)
            found[k] = d.drop("date", "interval")
    if not found:
        raise ValueError(f"nothing in {path}")
    return combined(found)


def selected(df: DataFrame, wanted: list[str] | None = None, first=None, last=None) -> DataFrame:
    """Symbol, time and the wanted columns that are there; without any, all numeric ones."""
    df = between(df, first, last)
    there = [c for c in wanted or () if c in df.columns]
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int") and c not in ("symbol", "bar_ts")]
    return df.select(*[c for c in ("symbol", "bar_ts") if c in df.columns], *(there or numeric))


def process_and_save(bars: DataFrame, path: str, interval: str) -> tuple[str, str, str]:
    """Checks bars, makes and checks features, makes signals, and writes all three. The first bar that breaks a rule is an error."""
    bad = bars.withColumn("faults", faults()).where(F.size("faults") > 0).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].symbol} {bad[0].bar_ts}: {', '.join(bad[0].faults)}")
    feats = F_.features(bars)
    for kind, d in (("ohlcv", bars), ("features", feats.select("symbol", "bar_ts", *F_.NAMES)), ("signals", F_.signals(feats))):
        write_partitioned(d, path, interval, kind)
    return tuple(f"{path.rstrip('/')}/{k}" for k in ("ohlcv", "features", "signals"))


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, CSV with a header, or JSON lines, in which numbers that aren't finite are null."""
    if kind == "json":
        odd = [c for c, t in df.dtypes if t in ("double", "float")]
        df = df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in odd}) if odd else df
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {kind}")


def faults(lead_ts: Column | None = None, timed_rows: bool = False) -> Column:
    """The names of the rules that a bar breaks; null fields break theirs."""
    rules = {
        "time": F.unix_timestamp("bar_ts") > 0 if timed_rows else F.lit(True),
        "price": (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0),
        "range": F.col("high") >= F.col("low"),
        "bracket": (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")),
        "volume": F.col("volume") >= 0,
        "level": ((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4).between(1e-4, 1e6),
    }
    if lead_ts is not None:
        rules["order"] = lead_ts.isNull() | (F.col("bar_ts") > lead_ts)
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
