"""Records of a run as JSON lines with a contract, audits, and messages for queues and streams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import folder_checksum, read_text, row_checksum, write_text

VERSION = "imp.runtime.output.v1"  # fixed value: the contract's name
RECORD = "schema_version string, symbol string, timestamp long, ohlcv struct<open: double, high: double, low: double, close: double, volume: double>, signals struct<s_ldc: double, s_mr: double, s_tsmom: double>, fused struct<score: double, side: string>, checksum string"


def records(rows: DataFrame) -> DataFrame:
    """rows(symbol, bar_ts, open .. volume, s_ldc, s_mr, s_tsmom, score, side) -> nested records with a checksum of their values."""
    nest = {"ohlcv": ("open", "high", "low", "close", "volume"), "signals": ("s_ldc", "s_mr", "s_tsmom")}
    parts = [F.struct(*[F.col(c).cast("double").alias(c) for c in cs]).alias(n) for n, cs in nest.items()]
    d = rows.select(F.lit(VERSION).alias("schema_version"), "symbol", F.unix_timestamp("bar_ts").alias("timestamp"), *parts, F.struct(F.col("score").cast("double").alias("score"), "side").alias("fused"))
    return d.withColumn("checksum", row_checksum(*d.columns))


def write_run(recs: DataFrame, path: str) -> dict:
    """JSON lines in a folder and a summary beside it: rows, first and last time, and a checksum of the files."""
    spark = recs.sparkSession
    odd = lambda c: F.when(F.abs(c) < float("inf"), c)  # noqa: E731  numbers that aren't finite are null
    clean = recs.withColumn("fused", F.struct(odd(F.col("fused.score")).alias("score"), F.col("fused.side").alias("side")))
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    back = spark.read.schema(RECORD).json(path).agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("z")).first()
    summary = {"schema_version": VERSION, "row_count": back.n, "first_timestamp": back.a, "last_timestamp": back.z, "sha256": folder_checksum(spark, path)}
    write_text(spark, f"{path.rstrip('/')}.summary.json", json.dumps(summary, sort_keys=True))
    return summary


def read_run(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Records of a run; with verify the files' checksum, the number of rows and the version of all must be as the summary says."""
    d = spark.read.schema(RECORD).json(path)
    if verify:
        summary = json.loads(read_text(spark, f"{path.rstrip('/')}.summary.json"))
        if summary["sha256"] != folder_checksum(spark, path):
            raise ValueError("the files aren't those of the summary")
        got = d.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("schema_version") != VERSION, F.lit(True))).alias("other")).first()
        if got.other:
            raise ValueError(f"{got.other} records aren't of {VERSION}")
        if got.n != summary["row_count"]:
            raise ValueError(f"{got.n} rows instead of {summary['row_count']}")
    return d


def frames(recs: DataFrame, symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, bars) of records; those without signals have a bar only."""
    d = recs if symbol is None else recs.where(F.col("symbol") == symbol)
    d = d.withColumn("bar_ts", F.timestamp_seconds("timestamp"))
    return d.where("signals is not null").select("symbol", "bar_ts", "signals.*", "fused.*"), d.select("symbol", "bar_ts", "ohlcv.*")


def sound(recs: DataFrame) -> DataFrame:
    """recs with whether the checksum is that of the values."""
    return recs.withColumn("sound", F.col("checksum") == row_checksum(*[c for c in recs.columns if c != "checksum"]))


def audit(rows: DataFrame, path: str, kind: str) -> None:
    """Appends rows as JSON lines with their kind and checksum."""
    d = rows.withColumn("kind", F.lit(kind))
    d.withColumn("checksum", row_checksum(*d.columns)).write.mode("append").option("ignoreNullFields", False).json(path)


def flattened(df: DataFrame, prefix: str = "") -> Column:
    """A map of names to texts of all fields, those of nested ones behind their parent's name, arrays and maps as JSON."""
    pairs: list[Column] = []

    def walk(kind, path: list[str]) -> None:
        for f in kind.fields:
            at = [*path, f.name]
            c = F.col(".".join(f"`{x}`" for x in at))
            if f.dataType.typeName() == "struct":
                walk(f.dataType, at)
            else:
                text = F.to_json(c) if f.dataType.typeName() in ("array", "map") else c.cast("string")
                pairs.extend((F.lit(prefix + "_".join(at)), text))

    walk(df.schema, [])
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def message_key(how: str, symbol: str = "symbol", template: str = "{symbol}") -> Column:
    """symbol, none, random (by the row's own hash, so that a repeated task gives the same), or a template of columns."""
    if how == "symbol":
        return F.col(symbol)
    if how == "none":
        return F.lit(None).cast("string")
    if how == "random":
        return F.hex(F.xxhash64(F.col(symbol), F.monotonically_increasing_id()))
    parts = [F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(template.replace("}", "{").split("{"))]
    return F.concat(*parts)


def messages(df: DataFrame, how: str = "symbol", template: str = "{symbol}") -> DataFrame:
    """(key, value) for a queue: the row as JSON."""
    return df.select(message_key(how, template=template).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def stream_name(how: str, symbol: str = "symbol", name: str = "signals") -> Column:
    """One stream for all, one for each symbol, or a name of one's own."""
    return F.concat(F.lit(f"{name}:"), F.col(symbol)) if how == "symbol" else F.lit(f"{name}:all" if how == "all" else name)
