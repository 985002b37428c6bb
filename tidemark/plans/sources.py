"""Queries that write bars, signals and records, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.plans import fusion
from tidemark.plans.features import FEATURES
from tidemark.plans.registry import r6, registered
from tidemark.sources import market, records
from tidemark.sources.storage import new_dir


@registered(" select symbol, bar_ts, open, high, low, close, volume, '1h' as interval from b where symbol in ('view', 'click') and day(bar_ts) between 5 and 20", "hour")
def partitioned_bars(b):
    """Written in two halves, which both stay, and read by symbols, days and interval."""
    path = new_dir(b.sparkSession, "parts")
    for k in (0, 1):
        market.write_partitioned(b.where(F.day("bar_ts") % 2 == k), path, "1h")
    d = market.read_partitioned(b.sparkSession, path, "ohlcv", ["view", "click"], interval="1h").where(F.day("date").between(5, 20))
    return d.select("symbol", "bar_ts", "open", "high", "low", "close", "volume", "interval")


@registered(FEATURES + ", s as (select symbol, bar_ts, -zscore_20 / greatest(std_20, 1e-8) as m, momentum as t from f) select symbol, bar_ts, close, round(case when abs(m) < 0.1 then 0 else m end, 6) as s_mr, round(case when abs(t) < 0.01 then 0 else t end, 6) as s_tsmom, round(rsi, 6) as rsi from s join f using (symbol, bar_ts)", "hour")
def saved_pipeline(b):
    """Bars, features and signals are made, written by day and joined again by symbol and time."""
    path = new_dir(b.sparkSession, "pipeline")
    feats = features.features(b)
    for kind, d in (("ohlcv", b), ("features", feats.select("symbol", "bar_ts", *features.NAMES)), ("signals", features.signals(feats))):
        market.write_partitioned(d, path, "1h", kind)
    return market.load_outputs(b.sparkSession, path).select("symbol", "bar_ts", "close", *r6(s_mr="s_mr", s_tsmom="s_tsmom", rsi="rsi"))


@registered(" select symbol, epoch(bar_ts)::bigint as \"timestamp\", open, high, low, close, volume::double as volume, n from b, (select unnest(['csv', 'json', 'parquet']) as n)")
def format_round_trips(b):
    """Bars through CSV, JSON lines and Parquet."""
    rows = b.select("symbol", F.unix_timestamp("bar_ts").alias("timestamp"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    out = None
    for kind in ("csv", "json", "parquet"):
        path = f"{new_dir(b.sparkSession, 'formats')}/bars.{kind}"
        market.write(rows, path, kind)
        d = market.typed(market.load(b.sparkSession, path).withColumn("symbol", F.col("symbol").cast("string"))).withColumn("n", F.lit(kind))
        out = d if out is None else out.unionByName(d)
    return out


@registered(fusion.FUSED + " select symbol, bar_ts, round(s_ldc, 6) as s_ldc, round(s_mr, 6) as s_mr, round(score, 6) as score, side, close, true as sound from h join b using (symbol, bar_ts, close)")
def verified_run(b):
    """Records as JSON lines with a summary, read back under its checks."""
    path = f"{new_dir(b.sparkSession, 'run')}/records"
    rows = fusion.fused(b).join(b.select("symbol", "bar_ts", "open", "high", "low"), ["symbol", "bar_ts"])
    records.write_run(records.records(rows), path)
    back = records.sound(records.read_run(b.sparkSession, path))
    s, bars = records.frames(back)
    d = s.join(bars.select("symbol", "bar_ts", "close"), ["symbol", "bar_ts"]).join(back.select("symbol", F.timestamp_seconds("timestamp").alias("bar_ts"), "sound"), ["symbol", "bar_ts"])
    return d.select("symbol", "bar_ts", *r6(s_ldc="s_ldc", s_mr="s_mr", score="score"), "side", "close", "sound")


@registered(" select symbol, bar_ts, symbol || ':' || day(bar_ts)::varchar as key, 'signals:' || symbol as stream, 7 as n_fields, volume::varchar as flat_volume from b")
def queue_messages(b):
    """Keys by a template, streams by symbol, and the flat fields of nested rows."""
    d = b.withColumn("day", F.day("bar_ts")).withColumn("prices", F.struct("open", "high", "low", F.array("close").alias("closes")))
    flat = d.select("symbol", "bar_ts", "day", "prices", "volume").drop("day")
    key = records.message_key("template", template="{symbol}:{day}")
    return d.select("symbol", "bar_ts", key.alias("key"), records.stream_name("symbol").alias("stream"), F.size(records.flattened(flat)).alias("n_fields"), records.flattened(flat)["volume"].alias("flat_volume"))
