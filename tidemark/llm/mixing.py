"""Mixing a corpus to target weights with soft domains.

A logistic classifier on hashed words, marks and a few measures of the text (one domain against the rest), fitted on a labelled
table, gives each document a posterior for each domain. A document's rate x >= 0 says how often it
is to be used; the expected tokens of domain d are sum(x * tokens * p[d]). At rate 1, part of them is in documents that are mostly d's, part in others;
the target is a share of the first part and all of the second, so that it can be reached without the documents of other domains. The rates are fitted by projected gradient steps on the squared distance to the targets, from rate 1: each step moves
every rate along the gradient, scaled by the second moments of the posteriors among documents in use, and puts negative rates to 0.
A step is one pass over a narrow table and a sum of a few numbers: no shuffle, only the sums reach the
driver, and a pass replays the steps before it, of a few numbers each. Steps go on until each target is met to TOLERANCE of what its domain
holds (converged), or nothing moves any more or STEPS are done, with a warning; gap is what is left, as a share.

Edge cases: null or empty texts have no tokens, and a posterior and a rate like others; repeated rows are rated each; texts of equal
posteriors have equal rates; unknown or null labels don't count; without labels of two domains all rates are 1 where
targets allow; a target for a domain without documents is left out; extra columns, also of clashing names, pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, encoded, map_batches
from tidemark.llm.common import mix as mixed_hash
from tidemark.llm.common import numbered, pick, place_of, written
from tidemark.llm.quality import logistic

BITS = 18
#: Of each domain, the share of its tokens, in documents mostly its own, that the mix is to hold.
TARGETS = {"clean": 1.0, "junk": 0.25, "toxic": 0.1}
#: The classifier's features: so many at most, whose share in a domain is at least so many deviations off.
MOST_FEATURES, LEAST_Z = 400, 4.0
STEPS = 40
TOLERANCE = 1e-3
#: Rates this close to a whole number are rounded when they are realised.
SNAP = 0.25
MARKS = bytes(b if chr(b).isprintable() and b < 127 and not chr(b).isalnum() else 32 for b in range(256))
CAPITALS = bytes(b if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    weights: np.ndarray  # (2 ** BITS, domains): weight of each feature
    prior: np.ndarray


def _features(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, and pairs of a text and a feature, once each): hashed words, hashed runs of marks, and eighths of the shares of
    words in capitals, of words that are distinct, and of runs of marks."""
    words, marks, capitals = Words(texts), Words(texts, MARKS), Words(texts, CAPITALS)
    h, n = words.hashes(), np.maximum(1, np.diff(words.first))
    place = lambda x: (x >> np.uint64(64 - BITS)).astype(np.int64)
    _, distinct = np.unique(mixed_hash(h + words.doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), return_index=True)
    counts = [capitals.doc[capitals.end - capitals.start >= 4], words.doc[distinct], marks.doc[marks.end - marks.start >= 2]]
    shares = [np.minimum(8, 8 * np.bincount(d, minlength=len(texts)) // n) for d in counts]
    doc = np.concatenate([words.doc, marks.doc, *[np.arange(len(texts))] * 3])
    f = np.concatenate([place(h), place(marks.hashes() * np.uint64(0x9E3779B97F4A7C15)), *[(1 << BITS) - 1 - 16 * k - x for k, x in enumerate(shares)]])
    pair = np.unique(doc * (1 << BITS) + f)
    return words, pair >> BITS, pair & ((1 << BITS) - 1)


def fit(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], per_domain: int = 1500, max_chars: int = 20_000) -> DomainModel:
    """labels(doc_id, domain). Of each domain at most per_domain documents, the smallest by hash, without texts over max_chars."""
    own = pick(labels, doc_id="doc_id", domain="domain").where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    there = pick(docs, doc_id="doc_id").where("doc_id is not null").distinct()  # labels of documents that are gone say nothing
    own = written(own.join(there, "doc_id", "left_semi"), "labels")
    known = {r.domain: r.n for r in own.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = np.array([known.get(d, 0) + 1.0 for d in domains])
    present = np.zeros((1 << BITS, len(domains)))
    n = np.zeros(len(domains))
    pairs, own_domain = [], []
    part = [own.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain) for d in domains]
    chosen = part[0]
    for more in part[1:]:
        chosen = chosen.unionByName(more)
    texts = pick(docs, doc_id="doc_id", text="text").where(F.length("text").between(1, max_chars)).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("domain", "doc_id").agg(F.min("text").alias("text")).orderBy("domain", "doc_id").collect()  # repeated rows once
    for k, d in enumerate(domains):
        got = [r.text.encode() for r in texts if r.domain == d]
        _, doc, f = _features(got)
        np.add.at(present[:, k], f, 1)
        pairs += [doc + int(n.sum()), f]
        own_domain += [k] * len(got)
        n[k] = len(got)
    weights, bias = np.zeros((1 << BITS, len(domains))), np.log(prior / prior.sum())
    bias[[d not in known for d in domains]] = -30.0 if known else 0.0
    if (n > 0).sum() < 2:
        return DomainModel(domains, weights, bias)
    pooled = present.sum(1, keepdims=True) / n.sum()
    z = (np.abs(present - n * pooled) / np.sqrt(n * pooled * (1 - pooled) + 0.5)).max(1)
    chosen = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    chosen = chosen[z[chosen] >= LEAST_Z]
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    doc, word = np.concatenate(pairs[0::2]), column[np.concatenate(pairs[1::2])]
    x = np.zeros((int(n.sum()), len(chosen) + 1))
    x[:, -1] = 1
    x[doc[word >= 0], word[word >= 0]] = 1
    y = np.array(own_domain)
    share = (n + 1e-9) / n.sum()
    w = (prior / prior.sum() / share)[y]  # the sample's domains count as in the labels
    for k in np.flatnonzero(n):
        beta = logistic(x, (y == k).astype(float), w)
        weights[chosen, k], bias[k] = beta[:-1], beta[-1]
    return DomainModel(domains, weights, bias)


def posteriors(texts: list[bytes], model: DomainModel) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, word counts); a feature counts once a text."""
    words, doc, f = _features(texts)
    s = np.tile(model.prior, (len(texts), 1))
    w = model.weights[f]
    np.add.at(s, doc[(used := w.any(axis=1))], w[used])
    p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    return p / p.sum(1, keepdims=True), np.diff(words.first)


def replayed(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents of these posteriors after projected steps."""
    x = np.ones(len(p))
    for u in steps:
        x = np.maximum(0.0, x - p @ u)
    return x


def solve(totals, goal: np.ndarray) -> tuple[list[np.ndarray], float, bool]:
    """(steps, largest gap, converged). totals(steps): expected tokens of the domains, and second moments of the posteriors by
    tokens in use, after these steps; goal: the targets."""
    own, gram = totals([])
    known = own > 1e-9 * own.sum()
    scale = np.maximum(own, 1e-300)

    def gap(now: np.ndarray) -> float:
        return float((np.abs(now - goal) / scale)[known].max(initial=0.0))

    steps, now, size = [], own, 1.0
    for _ in range(STEPS):
        if gap(now) <= TOLERANCE:
            return steps, gap(now), True
        u = np.linalg.solve(gram + 1e-9 * max(own.sum(), 1e-300) * np.eye(len(own)), now - goal)
        new, new_gram = totals([*steps, size * u])
        r, s = now - goal, new - goal
        if (s / scale)[known] @ (s / scale)[known] < (r / scale)[known] @ (r / scale)[known]:
            steps, now, gram, size = [*steps, size * u], new, new_gram, min(1.0, 2 * size)
        else:
            size /= 2
            if size < 1e-3:
                break
    return steps, gap(now), gap(now) <= TOLERANCE


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float]) -> DataFrame:
    """(key, doc_id, n_tokens, posterior, rate, gap, converged) of each row of docs; key is a hash of the text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS rows
    k = len(model.domains)

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        p, n = posteriors(encoded(b.column(1)), shared.value)
        arr = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * k, pa.int32()), pa.array(p.ravel()))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n.astype(np.int64)), arr], names=["doc_id", "key", "n_tokens", "posterior"])

    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", "text", F.xxhash64("text").alias("key"))
    soft = written(map_batches(rows, each, "doc_id long, key long, n_tokens long, posterior array<double>"), "posteriors")

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def some(b: pa.RecordBatch) -> pa.RecordBatch:
            p = np.array(b.column(1).values.to_numpy()).reshape(-1, k)
            n = b.column(0).to_numpy().astype(float)
            x = replayed(p, steps)
            v = np.concatenate(((x * n) @ p, ((n * (x > 0))[:, None] * p).T.dot(p).ravel()))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])

        got = map_batches(soft.select("n_tokens", "posterior"), some, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(k + k * k)
        for r in got:
            v[r.i] = r.v
        return v[:k], v[k:].reshape(k, k)

    p, n = F.col("posterior"), F.col("n_tokens")
    main = F.array_position(p, F.array_max(p)) - 1
    parts = soft.agg(*[F.sum(F.when((main == i) == own, n * p[i])).alias(f"{own}{i}") for i in range(k) for own in (True, False)]).first()
    own, other = (np.array([parts[f"{x}{i}"] or 0.0 for i in range(k)]) for x in (True, False))
    steps, gap, converged = solve(totals, other + own * [max(0.0, targets.get(d, 1.0)) for d in model.domains])
    if not converged:
        warnings.warn(f"mixing: a target is missed by {gap:.2g} of its domain's tokens", stacklevel=2)

    def rated(b: pa.RecordBatch) -> pa.RecordBatch:
        p = np.array(b.column(3).values.to_numpy()).reshape(-1, k)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(replayed(p, steps))], names=["doc_id", "key", "n_tokens", "posterior", "rate"])

    out = map_batches(soft, rated, "doc_id long, key long, n_tokens long, posterior array<double>, rate double")
    return out.withColumns({"gap": F.lit(gap), "converged": F.lit(converged)})


def domains_of(labels: DataFrame) -> DataFrame:
    """Toxic text, else junk by its quality, else clean."""
    known = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("toxic in (0, 1) or quality = 0")
    return known.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").otherwise("clean").alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, fit(docs, domains_of(labels), tuple(sorted(TARGETS))), TARGETS)


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    own = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return mixed(docs, labels).select("doc_id", "n_tokens", *own, "rate", "gap", "converged")


def copies(rate, key):
    """How often a text of this rate is used: rates within SNAP of a whole number are rounded, others go up or down by a hash, so
    that they are met in the mean."""
    part = rate - F.floor(rate)
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit(11)), 11) / float(1 << 53)
    return F.when(part <= SNAP, F.floor(rate)).when(part >= 1 - SNAP, F.ceil(rate)).otherwise(F.floor(rate) + (u < part).cast("long")).cast("int")


def realised(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs as often as their rates say, with docs' columns. A row is found again by its doc_id and text, and equal
    ones have equal rates; rows of one use, nearly all, are passed on without a table of them."""
    use = mixed(docs, labels).select(F.col("doc_id").alias("use_id"), F.col("key").alias("use_key"), copies(F.col("rate"), "key").alias("use")).where("use <> 1").distinct()
    inner = numbered(docs)
    d, t = (F.col(f"_{place_of(docs, c)}") for c in ("doc_id", "text"))
    found = inner.join(use, d.eqNullSafe(F.col("use_id")) & F.xxhash64(t).eqNullSafe(F.col("use_key")), "left")
    often = F.coalesce("use", F.lit(1))
    out = found.where(often > 0).withColumn("use", F.explode(F.when(often > 1, F.sequence(F.lit(1), often)).otherwise(F.array(F.lit(1)))))
    return out.select(*inner.columns).toDF(*docs.columns)
