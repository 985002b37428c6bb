"""Queries against their SQL on small tables of odd values, a day's bar an event."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fusion
from tidemark.plans.queries import QUERIES, SQL


@pytest.fixture
def differ(spark, tmp_path):
    """differ(query, closes by user): the rows that only the query or only its SQL returns, as text; not a number equals itself."""

    def run(name: str, series: dict[int, list[float]]) -> list:
        rows = [(u * 1000 + i, dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=i), u, "view", v, "") for u, x in series.items() for i, v in enumerate(x)]
        pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
        got = QUERIES[name](spark, str(tmp_path))
        c = duckdb.connect()
        c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
        want = c.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
        text = lambda rows: {repr(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows}
        assert want
        return sorted(text(map(tuple, got.collect())) ^ text(want))

    return run


#: Closes that begin with 0, hold nothing else, or fall to it.
ZEROS = {1: [0.0, 5.0, 3.0, 8.0, 2.0, 9.0, 1.0], 2: [0.0, 0.0, 0.0], 3: [4.0, 0.0, 6.0, 2.0, 0.0, 3.0], 4: [0.0, 0.0, 7.0, 1.0, 2.0, 0.0], 5: [2.0, 3.0, 1.0, 5.0, 4.0], 6: [0.0]}


@pytest.mark.parametrize("name", ["drawdown_periods", "performance", "regime_performance", "regime_summary"])
def test_series_that_begin_with_0(differ, name):
    assert differ(name, ZEROS) == []


def test_regimes_of_infinite_returns_and_of_none(differ):
    """Two regimes with an infinite return; one infinite, one not a number, one finite; one not a number and two finite."""
    assert differ("regime_summary", {1: [0.0, 3.0, 9.0, 6.0, 1.0, 0.0, 4.0, 1.0], 2: [0.0, 6.0, 9.0, 4.0, 3.0, 4.0, 3.0, 1.0, 0.0], 3: [6.0, 1.0, 9.0, 2.0, 3.0, 4.0, 0.0, 1.0, 0.0]}) == []


def test_no_short_entry_at_the_average_itself(differ):
    assert differ("held_signals", {1: [100.0, 40.0, 60.0, 60.0, 65.0, 66.0, 67.0], 2: [100.0, 40.0, 60.0, 60.0, 64.0]}) == []


def test_ranges_equal_to_their_mean(differ):
    """The last step is the mean of the nine before, in cents."""
    a = [236.43, 262.74, 74.96, 193.7, 33.49, 295.37, 104.01, 10.02, 7.31, 8.33, 212.84, 177.41, 3.01, 288.76, 124.85, 252.97]
    b = [192.53, 289.17, 163.63, 277.28, 165.57, 128.89, 193.0, 279.6, 11.31, 157.36, 79.54, 243.7, 261.29, 132.47, 135.82, 242.13]
    assert differ("entry_filters", {1: a, 2: b}) == []


CLOSE_TO_MEAN = [
    [249.36, 147.29, 154.75, 213.52, 124.4, 258.45, 68.8, 30.76, 159.91, 156.36],
    [94.96, 7.05, 136.38, 274.46, 182.34, 210.47, 32.77, 60.92, 206.29, 133.96],
    [157.37, 79.55, 243.71, 261.3, 132.48, 135.77, 217.83, 56.7, 120.37, 156.12],
    [277.7, 189.34, 115.77, 150.45, 298.11, 88.24, 216.02, 179.57, 199.57, 190.53],
]


def test_texts_of_a_close_next_to_its_mean(differ):
    """The last close is the mean in cents, and the mean of doubles is less."""
    assert differ("signal_texts", dict(enumerate(CLOSE_TO_MEAN))) == []


def test_thousandths_as_printf_has_them(spark):
    x = [s * (k / 10000 + e) for k in range(5, 3000, 10) for e in (0.0, 1e-12) for s in (1, -1)] + [0.0625, 0.1875, -0.0, 0.0, -0.0001, 1e-300, 123456.7895, 5e15]
    d = spark.createDataFrame([(v,) for v in x], "x double").select("x", fusion.cache_key([F.col("x")]).alias("y"))
    assert [(r.x, r.y) for r in d.collect()] == [(v, f"{v:.3f}") for v in x]


def test_signals_halfway_between_millionths(differ):
    """Two closes at a distance of 5.12 have a signal of 0.1953125."""
    assert differ("banded_signals", {u: [u + 0.37 * (u % 7), round(u + 0.37 * (u % 7) + (5.12 if u % 2 else -5.12), 2)] for u in range(6, 300)}) == []
