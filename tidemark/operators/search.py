"""Neighbour search over a symbol's earlier bars: exact, by the ordered scan with a running bound, and approximate by buckets; votes and confidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import by_symbol, spread


def lorentzian(a: Column, b: Column, n: int | None = None) -> Column:
    """Sum of ln(1 + |difference|) over the components both have, or the first n of them."""
    size = F.least(F.size(a), F.size(b), *([F.lit(n)] if n else []))
    pairs = F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size), lambda x, y: F.log(1 + F.abs(x.cast("double") - y.cast("double"))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows) in double precision, a component after the other."""
    out = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        out += np.log1p(np.abs(q[:, k, None] - x[None, :, k]))
    return np.round(out, 9)


def scanned(d: np.ndarray, label: np.ndarray, k: int, spacing: int = 4) -> tuple[list[float], list[int]]:
    """Of distances to samples in time order (thinned already): each spacing-th that isn't nearer than a running bound is taken and, beyond k of them, the one taken
    first goes and the bound falls to the one three quarters up the list. Sorted by distance."""
    bound, near = -1.0, []
    for i in range(0, len(d), spacing):
        if d[i] >= bound:
            bound = d[i]
            near.append((d[i], int(label[i])))
            if len(near) > k:
                near.pop(0)
                if len(near) > 3:
                    bound = near[min(k * 3 // 4, len(near) - 1)][0]
    near.sort(key=lambda x: x[0])
    return [a for a, _ in near], [b for _, b in near]


PREDICTION = "symbol string, bar_ts timestamp, vote int, n int, direction int, confidence double, weighed double, nearness double, distances array<double>"


def predict(rows: DataFrame, features: list[str], mode: str = "exact", k: int = 8, spacing: int = 4, back: int = 2000, horizon: int = 4, many: int = 100, block: int = 1000) -> DataFrame:
    """rows(symbol, bar_ts, label, features) -> PREDICTION of each bar with features, from samples at least horizon bars old and at most back bars, each spacing-th
    by number. exact: the k nearest, ties to the older. scan: the ordered scan. auto: the scan up to many samples and beyond that the k nearest of each
    spacing-th of them. vote sums labels; confidence is 1 / (1 + deviation of distances); weighed compares weights 1 / (1 + d) of both sides; nearness is 1 / (1 + mean distance).
    Blocks of a symbol's bars are tasks of their own, each with the back bars before it, so a long series is dealt out."""
    if mode not in ("exact", "scan", "auto"):
        raise ValueError(f"unknown mode {mode}")
    numbered = rows.select("symbol", "bar_ts", "label", *features).withColumn("_i", (F.row_number().over(by_symbol()) - 1).cast("long"))
    own = F.floor(F.col("_i") / block)
    last = F.floor((F.count("*").over(Window.partitionBy("symbol")) - 1) / block)
    numbered = numbered.withColumn("_to", F.least(own + -(-(back + horizon) // block), last))
    # a bar goes to its block as a query, and as a sample to the blocks that may look back to it
    d = numbered.withColumn("_b", F.explode(F.when(F.col("label").isNotNull() & (F.col("_i") % spacing == 0), F.sequence(own, F.col("_to"))).otherwise(F.array(own)))).withColumn("_own", own)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=features).sort_values("_i")
        i, x = g._i.to_numpy(), g[features].to_numpy(float)
        q, s = (g._b == g._own).to_numpy(), (g.label.notna() & (g._i % spacing == 0)).to_numpy()
        si, sx, sl = i[s], x[s], g.label.to_numpy(float)[s]
        out, symbol, times = [], str(g.symbol.iloc[0]) if len(g) else "", list(g.bar_ts[q])
        for a in range(0, int(q.sum()), 256):
            qi, qx = i[q][a : a + 256], x[q][a : a + 256]
            dist = distances(qx, sx) if len(sx) else np.zeros((len(qx), 0))
            lo, hi = np.searchsorted(si, qi - back), np.searchsorted(si, qi - horizon, side="right")
            for j, t in enumerate(times[a : a + 256]):
                dd, ll = dist[j, lo[j] : hi[j]], sl[lo[j] : hi[j]]
                if not len(dd):
                    continue
                if mode == "scan" or (mode == "auto" and len(dd) <= many):
                    near, votes = scanned(dd, ll, k, spacing)
                    near, votes = np.array(near), np.array(votes)
                else:
                    if mode == "auto":
                        dd, ll = dd[::spacing], ll[::spacing]
                    if len(dd) > 4 * k:  # only what may be among the k nearest is sorted
                        some = np.flatnonzero(dd <= np.partition(dd, k - 1)[k - 1])
                        dd, ll = dd[some], ll[some]
                    best = np.argsort(dd, kind="stable")[:k]
                    near, votes = dd[best], ll[best]
                w, total = 1 / (1 + near), int(votes.sum())
                out.append((symbol, t, total, len(near), (total > 0) - (total < 0), 1 / (1 + float(near.std())), float(w @ votes / w.sum()), 1 / (1 + float(near.mean())), near))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PREDICTION.split(", ")])

    return spread(d, "symbol", "_b").groupBy("symbol", "_b").applyInPandas(one, PREDICTION)


def bucketed(vectors: DataFrame, queries: DataFrame, features: list[str], k: int = 8, width: float = 1.0, tables: int = 4, seed: int = 3) -> DataFrame:
    """vectors(id, features), queries(query, features) -> (query, id, distance, place): candidates that share a bucket of a random projection (Euclidean) in any of the
    tables, ranked again by the logarithmic distance; approximate."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((tables, len(features))), rng.random(tables)

    def hashed(df: DataFrame, keep: str) -> DataFrame:
        codes = [F.floor(sum((F.col(f) * float(w) for f, w in zip(features, a[t])), F.lit(0.0)) / width + float(b[t])) for t in range(tables)]
        return df.select(F.col(keep), F.array(*[F.col(f).cast("double") for f in features]).alias(f"v_{keep}"), F.posexplode(F.array(*codes)).alias("t", "code"))

    met = hashed(queries, "query").join(hashed(vectors, "id"), ["t", "code"]).dropDuplicates(["query", "id"])
    near = met.select("query", "id", F.round(lorentzian(F.col("v_query"), F.col("v_id")), 9).alias("distance"))
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("place") <= k)


def confidence(distances: Column) -> Column:
    """1 / (1 + deviation of the population) of an array of distances."""
    n = F.size(distances)
    mean = F.aggregate(distances, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(distances, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return 1 / (1 + F.sqrt(var))
