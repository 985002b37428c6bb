"""Signals that hold over bars: the last side that passed, how long it has held, flips, entries and exits, and turns of kernel averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B


def held(rows: DataFrame, raw: str = "raw", trend: int = 20, hold: int = 4, near: int = 3) -> DataFrame:
    """rows(symbol, bar_ts, close, raw) -> (symbol, bar_ts, side, held, early_flip, up_trend, enter_long, enter_short, strict_exit, bars_since): side is the
    last raw one that isn't null; held counts bars since it changed; a flip is early if another was within the bars before; entries are changes with
    the trend of an average, none where the close equals it; a strict exit is after hold bars."""
    w = B.by_symbol()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("side", F.last(raw, ignorenulls=True).over(upto))
    d = d.withColumns({"_turn": F.when(F.col("side").eqNullSafe(B.back("side")) & (F.row_number().over(w) > 1), 0).when(F.col("side").isNull(), 0).otherwise(1), "_i": F.row_number().over(w), "up_trend": F.col("close") > B.sma(trend), "_down": F.col("close") < B.sma(trend)})
    d = d.withColumns({"_run": F.sum("_turn").over(upto), "_before": F.coalesce(F.sum("_turn").over(w.rowsBetween(-near, -1)), F.lit(0))})
    d = d.withColumn("held", F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("bar_ts")) - 1)
    turn, side = F.col("_turn") == 1, F.col("side")
    return d.select(
        "symbol", "bar_ts", "side", "held", (turn & (F.col("_before") > 0)).alias("early_flip"), "up_trend", (turn & (side == 1) & F.col("up_trend")).alias("enter_long"), (turn & (side == -1) & F.col("_down")).alias("enter_short"),
        (F.col("held") == hold).alias("strict_exit"), (F.col("_i") - F.last(F.when(turn, F.col("_i")), ignorenulls=True).over(upto)).alias("bars_since"),
    )


def kernel_turns(bars: DataFrame, lookback: float = 8.0, lag: float = 2.0) -> DataFrame:
    """bars with y1 (rational quadratic) and y2 (Gaussian of a shorter lookback), their values before, and whether y1 rises or has turned, and whether y2 is over y1 or
    has crossed it."""
    d = bars.withColumns({"y1": B.kernel(B.rational_quadratic(lookback)), "y2": B.kernel(B.gaussian(lookback - lag))})
    d = d.withColumns({"y1_1": B.back("y1"), "y1_2": B.back("y1", 2), "y2_1": B.back("y2")})
    up = F.col("y1") > F.col("y1_1")
    return d.withColumns({
        "rising": up, "turned_up": up & (F.col("y1_1") < F.col("y1_2")), "turned_down": (F.col("y1") < F.col("y1_1")) & (F.col("y1_1") > F.col("y1_2")), "above": F.col("y2") >= F.col("y1"),
        "crossed_up": (F.col("y2") > F.col("y1")) & (F.col("y2_1") <= F.col("y1_1")), "crossed_down": (F.col("y2") < F.col("y1")) & (F.col("y2_1") >= F.col("y1_1")),
    })
