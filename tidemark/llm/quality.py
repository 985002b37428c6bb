"""Quality classifier by compression.

One zstandard dictionary is trained on texts labelled good and one on texts
labelled bad. A text is cut in blocks, each block is compressed with either
dictionary, and the difference of the summed sizes over the text's length is
its evidence: a text that the good dictionary makes smaller is good. A logistic
calibration, fitted on labelled texts that took no part in the dictionaries,
turns this difference and the ratio of compression (a text of one repeated word
shrinks to nothing under either dictionary) into a probability.

Edge cases: a null text counts as empty; empty texts have difference 0 and
ratio 1 and get a score like any other; texts of any length are scored whole,
block by block; repeated rows are scored one by one; extra columns pass
through; an empty table gives an empty result. Without a label of both classes
the score is the share of good labels (0.5 without any). A row without doc_id isn't held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_of_id, encoded, limit_batches, numbered, pick, place_of

#: Share of blocks kept for fitting the calibration instead of the dictionaries.
CALIBRATION_FOLDS = 3
SMOOTH = 48


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float
    block: int = 2048
    level: int = 3


def _compressors(model: QualityModel) -> tuple:
    out = []
    for d in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(d)
        d.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return tuple(out)


def sizes(text: bytes, compressors: tuple, block: int) -> tuple[int, int]:
    """Compressed bytes of the whole text under either dictionary, summed over its blocks."""
    good, bad = compressors
    a = b = 0
    for i in range(0, len(text), block):
        part = text[i : i + block]
        a += len(good.compress(part))
        b += len(bad.compress(part))
    return a, b


def _features(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = 10 * (b - a) / (np.maximum(a, b) + SMOOTH)
    ratio = np.log((np.minimum(a, b) + SMOOTH) / (n + SMOOTH))
    return np.stack([np.ones_like(diff), diff, np.minimum(diff, 0), ratio, ratio**2, diff * ratio, np.minimum(ratio + 1.5, 0)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - 0.5 * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 50_000, dict_bytes: int = 112_640, block: int = 2048, level: int = 3) -> QualityModel:
    """docs(doc_id, text), labels(doc_id, quality) of rows to learn from. The sample is bounded: of each class at most
    per_class labelled documents, those with the smallest hash of doc_id, without texts of over max_chars characters.
    A doc_id with two different labels counts as bad."""
    own = pick(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality in (0, 1)")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r.n for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    chosen = None
    for q in (0, 1):
        part = own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = pick(docs, doc_id="doc_id", text="text").where(F.length("text").between(1, max_chars))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # repeated rows once
    got = got.toPandas().sort_values("doc_id")  # at most 2 * per_class rows
    by = {q: [t.encode() for t in got.text[got.quality == q]] for q in (0, 1)}
    if min(len(by[0]), len(by[1])) < 8:
        return QualityModel(b"", b"", (), prior)
    dicts = {}
    for q in (0, 1):
        own_blocks = [t[i : i + block] for k, t in enumerate(by[q]) if k % CALIBRATION_FOLDS for i in range(0, len(t), block)]
        np.random.default_rng(7).shuffle(own_blocks)
        own_blocks = own_blocks[: max(64, 100 * dict_bytes // block)]
        try:
            dicts[q] = zstandard.train_dictionary(min(dict_bytes, sum(map(len, own_blocks)) // 4), own_blocks).as_bytes()
        except zstandard.ZstdError:  # too little text for a trained dictionary: the text itself is one
            dicts[q] = b"".join(own_blocks)[:dict_bytes]
    model = QualityModel(dicts[1], dicts[0], (), prior, block, level)
    cs = _compressors(model)
    rest = [(t, q) for q in (0, 1) for k, t in enumerate(by[q]) if k % CALIBRATION_FOLDS == 0]
    ab = np.array([sizes(t, cs, block) for t, _ in rest], float)
    n = np.array([len(t) for t, _ in rest], float)
    y = np.array([q for _, q in rest], float)
    w = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    return QualityModel(dicts[1], dicts[0], tuple(logistic(_features(n, ab[:, 0], ab[:, 1]), y, w)), prior, block, level)


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column more: the probability that the whole text is good. No shuffle."""
    spark = docs.sparkSession
    limit_batches(spark)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of at most 110 KB

    def each(batches):
        m = shared.value
        cs = _compressors(m) if m.weights else None
        for b in batches:
            if not b.num_rows:
                continue
            if cs is None:
                s = np.full(b.num_rows, m.prior)
            else:
                raw = encoded(b.column(at))
                ab = np.array([sizes(t, cs, m.block) for t in raw], float)
                x = _features(np.array([len(t) for t in raw], float), ab[:, 0], ab[:, 1])
                s = 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out])

    return docs.mapInArrow(each, schema)


def training_rows(labels: DataFrame, fold: int = 0, folds: int = 5) -> DataFrame:
    """Labels of all documents but the held-out fold."""
    return pick(labels, doc_id="doc_id", quality="quality").where(F.pmod(crc_of_id("doc_id"), F.lit(folds)) != fold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit(docs, training_rows(labels))
    got = score(pick(docs, doc_id="doc_id", text="text"), model)
    return got.select("doc_id", F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with docs' columns."""
    model = fit(docs, training_rows(labels))
    return score(numbered(docs), model, f"_{place_of(docs, 'text')}").where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
