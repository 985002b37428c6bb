"""Streaming twins of the folds: cooldowns and filtered states, with a state for each symbol that the engine keeps and recovers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators.hmm import Model


def _micros(t: pd.Series) -> np.ndarray:
    return t.astype("datetime64[us]").astype("int64").to_numpy()


def stream_cooled(rows: DataFrame, period: float) -> DataFrame:
    """rows(symbol, bar_ts, side) of a stream -> the same with emit: not HOLD, and at least period seconds after the last that left. The state
    is the time of that one; rows of a batch are taken in time order, so the result is that of the batch as long as batches are."""

    def one(key: tuple, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        d = pd.concat(list(parts)).sort_values("bar_ts")
        out = []
        for t, side in zip(_micros(d.bar_ts), d.side):
            go = side != "HOLD" and (last is None or t - last >= period * 1e6)
            last = int(t) if go else last
            out.append(go)
        if last is not None:
            state.update((last,))
        yield d.assign(emit=out)

    return rows.select("symbol", "bar_ts", "side").groupBy("symbol").applyInPandasWithState(one, "symbol string, bar_ts timestamp, side string, emit boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def stream_states(rows: DataFrame, model: Model, obs: list[str]) -> DataFrame:
    """rows(symbol, bar_ts, obs) of a stream -> (symbol, bar_ts, probs): filtered probabilities; the state is the symbol's last ones."""

    def one(key: tuple, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        p = np.array(state.get[0]) if state.exists else None
        d = pd.concat(list(parts)).dropna(subset=obs).sort_values("bar_ts")
        if not len(d):
            return
        ld = model.log_density(d[obs].to_numpy(float))
        out = []
        for row in ld:
            a = (model.start if p is None else p @ model.move) * np.exp(row - row.max())
            p = a / a.sum()
            out.append(p.tolist())
        state.update((out[-1],))
        yield pd.DataFrame({"symbol": d.symbol, "bar_ts": d.bar_ts, "probs": out})

    return rows.select("symbol", "bar_ts", *obs).groupBy("symbol").applyInPandasWithState(one, "symbol string, bar_ts timestamp, probs array<double>", "probs array<double>", "append", GroupStateTimeout.NoTimeout)


def on_time(rows: DataFrame, late: str = "1 hour", ahead: float = 300.0, now: str = "received", ts: str = "bar_ts") -> DataFrame:
    """Rows not more than ahead seconds after their arrival, under a watermark that drops those too late."""
    return rows.where(F.unix_timestamp(ts) - F.unix_timestamp(now) <= ahead).withWatermark(ts, late)
