import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.recurrences import recurrent


@pytest.fixture(scope="module")
def frame():
    i = np.arange(50)
    p = 100 + 0.1 * i + np.sin(0.05 * i)
    return pd.DataFrame({"symbol": "x", "bar_ts": [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * int(k)) for k in i], "open": p, "high": p * 1.02, "low": p * 0.98, "close": p * 1.01, "volume": 1000 + 10 * i})


def col(df, c):
    return df.orderBy("bar_ts").toPandas()[c].to_numpy(float)


def test_windows_against_pandas(spark, frame):
    b = spark.createDataFrame(frame)
    c = frame.close
    assert np.allclose(col(b.withColumn("y", B.sma()), "y"), c.rolling(20, min_periods=1).mean())
    assert np.allclose(col(b.withColumn("y", B.std()), "y")[1:], c.rolling(20, min_periods=2).std()[1:])
    assert np.allclose(col(b.withColumn("y", B.future_return(4)), "y")[:-4], ((c.shift(-4) - c) / c)[:-4])
    assert np.isnan(col(b.withColumn("y", B.when_full(B.sma(10), 10)), "y")).sum() == 9


def test_recurrences_against_a_loop(spark, frame):
    got = recurrent(spark.createDataFrame(frame)).orderBy("bar_ts").toPandas()
    ema = [frame.close[0]]
    for x in frame.close[1:]:
        ema.append(ema[-1] + (x - ema[-1]) * 2 / 21)
    assert np.allclose(got.ema, ema)
    assert got.rsi[0] == 100


def test_bars_break_ties_by_id(spark):
    t = dt.datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("a", t, 2, 5.0), ("a", t, 1, 3.0), ("a", t, 3, 4.0)], "event_type string, ts timestamp, event_id long, value double")
    r = B.bars_from_ticks(ticks).first()
    assert (r.open, r.close, r.high, r.low, r.volume) == (3.0, 4.0, 5.0, 3.0, 3)


def test_labels(spark):
    got = [r.y for r in spark.createDataFrame([(0.03,), (-0.03,), (0.02,), (None,)], "r double").select(B.label_of(F.col("r")).alias("y")).collect()]
    assert got == ["Buy", "Sell", "Hold", None]
