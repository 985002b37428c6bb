"""Sinks outside of Spark, with what they need to survive: retries, circuit breakers, bounded buffers, caches with a time to live."""

from __future__ import annotations

import json
import random
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.sources.records import flattened, messages, stream_name


@dataclass(frozen=True)
class Backoff:
    first: float = 0.1
    most: float = 30.0
    jitter: float = 0.25
    attempts: int = 5

    def delay(self, attempt: int, u: float | None = None) -> float:
        """Doubled with each attempt (from 1) up to most, and up to jitter more or less by u in 0 .. 1."""
        d = min(self.first * 2 ** (attempt - 1), self.most)
        return d * (1 + self.jitter * (2 * (random.random() if u is None else u) - 1))

    def call(self, f: Callable, sleep: Callable[[float], None] = time.sleep):
        for k in range(1, self.attempts + 1):
            try:
                return f()
            except Exception:
                if k == self.attempts:
                    raise
                sleep(self.delay(k))


@dataclass
class Breaker:
    """closed; after failures in a row open, which lets nothing through; after wait seconds half open, where successes in a row close it and a failure opens it."""

    failures: int = 5
    successes: int = 2
    wait: float = 60.0
    state: str = "closed"
    count: int = 0
    since: float = 0.0

    def allowed(self, now: float) -> bool:
        if self.state == "open" and now - self.since >= self.wait:
            self.state, self.count = "half open", 0
        return self.state != "open"

    def succeeded(self) -> None:
        if self.state == "half open":
            self.count += 1
            if self.count >= self.successes:
                self.state, self.count = "closed", 0
        else:
            self.count = 0

    def failed(self, now: float) -> None:
        self.count += 1
        if self.state == "half open" or self.count >= self.failures:
            self.state, self.since, self.count = "open", now, 0


@dataclass
class Buffer:
    """At most size signals in the order they came. When it is full: drop_oldest, drop_newest, error, or drop_lowest confidence."""

    size: int = 1000
    full: str = "drop_oldest"
    held: list[dict] = field(default_factory=list)

    def push(self, signal: dict) -> bool:
        if len(self.held) >= self.size:
            if self.full == "error":
                raise OverflowError("the buffer is full")
            if self.full == "drop_newest":
                return False
            if self.full == "drop_lowest":
                low = min(range(len(self.held)), key=lambda i: self.held[i].get("confidence", 0.0))
                if self.held[low].get("confidence", 0.0) >= signal.get("confidence", 0.0):
                    return False
                self.held.pop(low)
            else:
                self.held.pop(0)
        self.held.append(signal)
        return True

    def pop(self) -> dict | None:
        return self.held.pop(0) if self.held else None

    def pop_highest(self) -> dict | None:
        if not self.held:
            return None
        return self.held.pop(max(range(len(self.held)), key=lambda i: (self.held[i].get("priority", 0), -i)))

    def dumps(self) -> str:
        return json.dumps({"size": self.size, "full": self.full, "held": self.held})

    @classmethod
    def loads(cls, text: str) -> Buffer:
        return cls(**json.loads(text))


class Cache:
    """Values by key for ttl seconds, the least recently used of over size go."""

    def __init__(self, size: int = 1000, ttl: float = 300.0):
        self.size, self.ttl, self.held = size, ttl, OrderedDict()

    @staticmethod
    def key(observations) -> tuple[int, ...]:
        return tuple(round(x * 1000) for x in observations)

    def put(self, key, value, now: float) -> None:
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)

    def get(self, key, now: float):
        if key not in self.held:
            return None
        at, value = self.held[key]
        if not 0 <= now - at <= self.ttl:
            del self.held[key]
            return None
        self.held.move_to_end(key)
        return value

    def expire(self, now: float) -> int:
        old = [k for k, (at, _) in self.held.items() if now - at > self.ttl]
        for k in old:
            del self.held[k]
        return len(old)


def resolve(observations, now: float, cache: Cache, model: Callable | None, static: dict[str, float] | None, previous: dict[str, float] | None = None, fail: bool = False) -> tuple[dict[str, float], str]:
    """(weights, where they are from): cache, model, then on failure previous, static or equal ones; with fail the model's error is raised."""
    key = Cache.key(observations)
    if (hit := cache.get(key, now)) is not None:
        return hit, "cache"
    if model is not None:
        try:
            w = model(observations)
            cache.put(key, w, now)
            return w, "model"
        except Exception:
            if fail:
                raise
            if previous is not None:
                return previous, "previous"
    if static is not None:
        cache.put(key, static, now)
        return static, "static"
    return dict.fromkeys(("w_ldc", "w_mr", "w_tsmom"), 1 / 3), "equal"


def to_redis(df: DataFrame, connect: Callable, how: str = "symbol", most: int = 10_000, backoff: Backoff = Backoff()) -> None:
    """Adds each row's flat fields to a stream, cut to about most entries. connect makes a client on the executor; it needs xadd."""
    rows = df.select(stream_name(how).alias("stream"), flattened(df).alias("fields"))

    def send(part: Iterator) -> None:
        client = connect()
        for r in part:
            backoff.call(lambda r=r: client.xadd(r.stream, dict(r.fields), maxlen=most, approximate=True))

    rows.foreachPartition(send)


def to_kafka(df: DataFrame, servers: str, topic: str, how: str = "symbol", template: str = "{symbol}") -> None:
    messages(df, how, template).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def published(df: DataFrame, backends: dict[str, Callable[[DataFrame], None]], all_must: bool = False) -> dict[str, str]:
    """Hands rows to each backend; what failed is told, or raised if all must do."""
    out = {}
    for name, f in backends.items():
        try:
            f(df)
            out[name] = "ok"
        except Exception as e:
            if all_must:
                raise
            out[name] = f"{type(e).__name__}: {e}"
    return out


def emitting(backends: dict[str, Callable[[DataFrame], None]], sound: Callable[[DataFrame], DataFrame] | None = None):
    """For writeStream.foreachBatch: each batch's sound rows go to all backends, once cached."""

    def each(batch: DataFrame, _: int) -> None:
        rows = (sound(batch) if sound else batch).persist()
        try:
            published(rows, backends, all_must=True)
        finally:
            rows.unpersist()

    return each


