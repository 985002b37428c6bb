"""Checks and fusion of signals, weights by state, decisions, texts of signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = ("s_ldc", "s_mr", "s_tsmom")

#: What holds of a sound signal; now is the time to judge its age by, an argument and never the clock.
RULES = {
    "components": "abs(s_ldc) <= 1 and abs(s_mr) <= 1 and abs(s_tsmom) <= 1",
    "weights": "abs(w_ldc) <= 1 and abs(w_mr) <= 1 and abs(w_tsmom) <= 1",
    "symbol": "length(symbol) between 3 and 20 and symbol rlike '^[A-Z0-9]+$'",
    "age": "now - at <= 3600 and at - now <= 300",
    "confidence": "confidence between 0 and 1",
    "strength": "abs(strength) <= 1",
    "consistency": "case side when 'BUY' then strength > 0 when 'SELL' then strength < 0 else true end",
    "probabilities": "forall(probs, p -> p between 0 and 1) and abs(aggregate(probs, 0D, (a, p) -> a + p) - 1) <= 0.01",
}


def faults(rules=tuple(RULES)) -> Column:
    """The names of the rules that a signal breaks, in order; unknown values break theirs."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(RULES[n]), F.lit(False)), F.lit(n)) for n in rules]))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def observation(raw: Column, index: Column, warmup: int) -> Column:
    """struct(value, status): x / (1 + |x|) within 1 of a finite value; else 0 and warmup or missing by the bar's index."""
    x = raw / (1 + F.abs(raw))
    return F.struct(F.when(finite(raw), F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0).alias("value"), F.when(finite(raw), "ready").when(index < warmup, "warmup").otherwise("missing").alias("status"))


def vote_observation(vote: Column, k: int, n_samples: Column, index: Column, warmup: int, least: int = 8) -> Column:
    """The same of a neighbour vote over k, once there are least samples."""
    fine = finite(vote) & (n_samples >= least)
    return F.struct(F.when(fine, F.greatest(F.least(vote / k, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0).alias("value"), F.when(fine, "ready").when(index < warmup, "warmup").otherwise("missing").alias("status"))


def row_policy(index: Column, warmup: int, status: list[Column], skip: bool = True) -> Column:
    """use, or skip while warming up, and for a missing signal after that skip or error."""
    ready = reduce(lambda a, b: a & b, [s == "ready" for s in status])
    return F.when(ready, "use").when(index < warmup, "skip").otherwise("skip" if skip else "error")


def normalised(weights: list[Column], default=(0.33, 0.33, 0.34)) -> list[Column]:
    """Weights over the sum of their sizes; the default where that is next to 0."""
    total = sum((F.abs(w) for w in weights[1:]), F.abs(weights[0]))
    return [F.when(total < 1e-6, d).otherwise(w / total) for w, d in zip(weights, default)]


def fused(signals: list[Column], weights: list[Column]) -> Column:
    """The weighed mean, or the plain weighed sum where the weights' sum isn't positive."""
    top = sum((s * w for s, w in zip(signals[1:], weights[1:])), signals[0] * weights[0])
    total = sum(weights[1:], weights[0])
    return F.when(total > 0, top / total).otherwise(top)


def decision(score: Column, signals: list[Column], least: float = 0.3, each=(0.5, 0.5, 0.5)) -> tuple[Column, Column]:
    """(side, strength): HOLD and 0 under least, and where no component is beyond its own threshold on that side."""
    up = reduce(lambda a, b: a | b, [s > t for s, t in zip(signals, each)])
    down = reduce(lambda a, b: a | b, [s < -t for s, t in zip(signals, each)])
    side = F.when((score >= least) & up, "BUY").when((score <= -least) & down, "SELL").otherwise("HOLD")
    return side, F.when(side == "HOLD", 0.0).otherwise(F.least(F.abs(score), F.lit(1.0)))


def dominant(signals: dict[str, Column], weights: dict[str, Column] | None = None) -> Column:
    """The name of the largest part, the first of equals."""
    part = [F.struct(F.abs(s * weights[n] if weights else s).alias("x"), F.lit(-k).alias("o"), F.lit(n).alias("name")) for k, (n, s) in enumerate(signals.items())]
    return F.array_max(F.array(*part))["name"]


def resolved(rows: DataFrame, keys=("symbol", "bar_ts"), order: str = "source") -> DataFrame:
    """One signal of each key: the strongest that isn't HOLD, else the first by order."""
    best = F.struct((F.col("side") != "HOLD").alias("a"), F.when(F.col("side") != "HOLD", F.col("strength")).otherwise(0.0).alias("b"))
    every = F.struct(*[c for c in rows.columns if c not in keys])
    first = F.min_by(every, F.struct((~best["a"]).alias("a"), (-best["b"]).alias("b"), F.col(order)))
    return rows.groupBy(*keys).agg(first.alias("_x")).select(*keys, "_x.*")


def blended(probs: Column, weights: list[dict[str, float]]) -> dict[str, Column]:
    """Weights of the states (a few rows, literals) blended by their probabilities, and scaled to a sum of 1; equal ones where the probabilities
    don't sum to about 1 or one is out of 0 .. 1."""
    names = list(weights[0])
    total = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p)
    sound = F.forall(probs, lambda p: (p >= 0) & (p <= 1)) & (F.abs(total - 1) <= 0.01)
    parts = {n: sum((probs[i] * w[n] for i, w in enumerate(weights)), F.lit(0.0)) for n in names}
    s = sum(parts.values(), F.lit(0.0))
    return {n: F.when(F.coalesce(sound, F.lit(False)) & (s > 0), x / s).otherwise(1 / len(names)) for n, x in parts.items()}


def sound_weights(weights: list[dict[str, float]], least: float = 0.0, most: float = 1.0) -> list[str]:
    """What is wrong with weights by state: names, sums, bounds."""
    out = []
    for i, w in enumerate(weights):
        if set(w) != set(weights[0]):
            out.append(f"state {i}: names")
        if abs(sum(w.values()) - 1) > 1e-6:
            out.append(f"state {i}: sum")
        if any(not least <= x <= most for x in w.values()):
            out.append(f"state {i}: bounds")
    return out


def state_weights(state: Column, table: dict[int, dict[str, float]], static: dict[str, float] | None = None, names=COMPONENTS) -> dict[str, Column]:
    """Weights by a state's number, from a small table; static ones if given, else equal ones for unknown states."""
    known = F.try_to_number(state.cast("string"), F.lit("999")).cast("int")
    out = {}
    for n in names:
        x = F.lit(static[n] if static else 1 / len(names))
        for s, w in sorted(table.items()):
            x = F.when(known == s, w[n]).otherwise(x)
        out[n] = F.lit(static[n]) if static else x
    return out


def thousandths(x: Column) -> Column:
    """x rounded to thousandths by its exact binary value, halves to even, as C's printf does; Java's format rounds the shortest decimal, halves up.
    The sign stays, that of 0 too."""
    a = F.abs(x)
    high = a * 134217729.0 - (a * 134217729.0 - a)  # the upper half of the bits: a thousand times it and the rest are exact
    whole = F.floor(a * 1000)
    over = (high * 1000 - (whole + 0.5)) + (a - high) * 1000
    n = F.when(over > 0, whole + 1).when(over < 0, whole).otherwise(whole + whole % 2)
    return F.when(a < 4e12, F.signum(x) * (n / 1000.0)).otherwise(x)


def cache_key(values: list[Column]) -> Column:
    return F.format_string("|".join(["%.3f"] * len(values)), *[thousandths(x) for x in values])


def rounded_key(x: Column) -> Column:
    return F.round(x * 1000).cast("int")


def compact(symbol: Column, side: Column, strength: Column, confidence: Column) -> Column:
    return F.format_string("%s %s strength=%.3f confidence=%.3f", symbol, side, thousandths(strength), thousandths(confidence))


def side_of(text: Column) -> Column:
    up = F.upper(F.trim(text))
    return F.when(up.isin("BUY", "SELL", "HOLD"), up)


def checksum(*parts: Column) -> Column:
    """16 hex digits of the parts' text; of this engine's own making."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)


SIGNAL = "symbol string, side string, strength double, confidence double, components struct<s_ldc: double, s_mr: double, s_tsmom: double>, probs array<double>"


def to_json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


def from_json(text: Column) -> Column:
    return F.from_json(text, SIGNAL)
