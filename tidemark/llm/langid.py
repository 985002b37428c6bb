"""Language identification of whole, mixed-language texts.

Each word is scored under each learned language by a smoothed model of its
character n-grams, hashed to the buckets of one table. The scripts of its characters
narrow the languages first: one that hardly ever uses a word's script isn't
considered for it. A Viterbi pass with a penalty for each switch labels the words,
and so the text's spans; the language of most letters is the text's, and its
share of them the score. All words of a batch are scored by array operations, and
all blocks of all its texts go through the Viterbi pass side by side. Scores are
whole numbers, so that results don't hang on batches or blocks.

The model is fitted on a bounded sample: about per_lang documents of each language (those with the
smallest hash of doc_id) and at most sample_docs in all, whole texts. Every language is
learned as long as there are no more than sample_docs, those of most documents first. Ids are
chosen first, their n-grams are counted where the texts are, and counts of at most 2 ** MODEL_BITS buckets reach the driver.

Edge cases: null text or one without a letter is `und` with score 0 and no spans;
without any learned language every text is `und`; numbers and marks score the
same in all languages and take their neighbours' label; equal scores go to the language that comes first in the alphabet;
repeated rows are labelled each, and learned from once; extra columns, also such that differ in case alone, are ignored;
an empty table gives an empty result; a text of any length is labelled whole, in memory of a few times its size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, crc_of_id, encoded, map_batches, mix, pick

#: First code points of runs of scripts, and their names ("" for none).
SCRIPT_RANGES = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00C0, "latin"), (0x0250, ""), (0x0370, "greek"),
    (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, ""), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, ""), (0x0B80, "tamil"), (0x0C00, ""), (0x0E00, "thai"), (0x0E80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
]
_FIRST = np.array([a for a, _ in SCRIPT_RANGES])
_KINDS = sorted({n for _, n in SCRIPT_RANGES} - {""})
_KIND = np.array([_KINDS.index(n) if n else len(_KINDS) for _, n in SCRIPT_RANGES])
#: A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.002
GRAMS = (2, 3, 4)
#: Scores are in units of 1 / UNIT. A word's worst score, and that of a language that its scripts exclude.
UNIT, WORST, EXCLUDED = 256, -12 * 256, -50 * 256
#: The table has at most 2 ** MODEL_BITS numbers, and 2 ** BUCKET_BITS buckets.
MODEL_BITS, BUCKET_BITS = 24, 18
#: Words of a Viterbi block; bytes of text scored at once; languages up to which texts are cut in blocks.
BLOCK, PIECE, BLOCK_LANGS = 128, 1 << 20, 16
_MULTIPLY = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # (buckets, languages): log probabilities in units of 1 / UNIT
    scripts: np.ndarray  # (scripts, languages): whether a language uses a script
    penalty: int = 6 * UNIT

    @property
    def bits(self) -> int:
        return len(self.table).bit_length() - 1


def bits_for(n_langs: int) -> int:
    return int(np.clip(MODEL_BITS - max(1, n_langs - 1).bit_length(), 8, BUCKET_BITS))


_LETTERS: np.ndarray | None = None


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)
    return _LETTERS[np.minimum(points, 0x2FFFF)]


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]


class Characters:
    """The code points of a list of words (UTF-8), a space before each and after the last; start: of each word's space."""

    def __init__(self, words: list[bytes]):
        self.points = np.frombuffer((b" " + b" ".join(words) + b" ").decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        gaps = np.flatnonzero(self.points == 32)
        self.start, self.end = gaps[:-1], gaps[1:]

    def grams(self, bits: int):
        """Of each length: (bucket of the n-gram from each place, whether it lies in one word and its edges)."""
        p = self.points.astype(np.uint64) + np.uint64(1)
        gap = self.points == 32
        h, inner = p[: len(p) - 1], np.zeros(len(p) - 1, bool)
        for n in range(2, max(GRAMS) + 1):
            m = len(p) - n + 1
            if m <= 0:
                return
            h = (h[:m] * np.uint64(_MULTIPLY)) ^ p[n - 1 :]
            if n > 2:
                inner = inner[:m] | gap[n - 2 : n - 2 + m]
            if n in GRAMS:
                yield (mix(h * np.uint64(_MULTIPLY)) >> np.uint64(64 - bits)).astype(np.int64), ~inner

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each place, by word."""
        return np.add.reduceat(values, self.start, axis=0, dtype=np.int64)

    def kinds(self) -> np.ndarray:
        return _KIND[np.searchsorted(_FIRST, self.points, side="right") - 1]


def word_scores(words: list[bytes], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(scores (words, languages), letters of each word): log likelihoods less the best one's, after the scripts
    narrowed the languages; zeros for a word without letters."""
    c = Characters(words)
    total = np.zeros((len(c.points) + 1, len(model.langs)), np.int64)
    for bucket, valid in c.grams(model.bits):
        own = model.table.take(bucket, axis=0)
        own[~valid] = 0
        total[1 : len(own) + 1] += own
    np.cumsum(total, axis=0, out=total)
    s = (total[c.end] - total[c.start]) // 2
    s -= s.max(axis=1, keepdims=True)
    np.maximum(s, WORST, out=s)
    used = np.bitwise_or.reduceat(1 << c.kinds(), c.start) & ((1 << len(_KINDS)) - 1)
    for kinds in np.unique(used).tolist():
        allowed = np.ones(len(model.langs), bool)
        for k in range(len(_KINDS)):
            if kinds >> k & 1 and model.scripts[k].any():
                allowed &= model.scripts[k]
        if allowed.any() and not allowed.all():
            s[np.ix_(used == kinds, ~allowed)] = EXCLUDED
    n = c.summed(letters(c.points))
    s[n == 0] = 0
    return s.astype(np.int16), n


def _step(v: np.ndarray, s: np.ndarray, penalty: int) -> np.ndarray:
    return np.maximum(v, v.max(axis=-1, keepdims=True) - penalty) + s


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: int, block: int = BLOCK) -> np.ndarray:
    """scores: (words, languages), whole numbers, of texts one after the other; first: index of each text's first word, and the end.
    The best label of each word, with a penalty for each switch within a text. Texts are cut in blocks. What a block does to the values of
    the languages is found for each language it may start from, for all blocks side by side; then come the values
    at the start of each block, one after the other; then all blocks' labels, side by side."""
    n, langs = scores.shape
    label = np.zeros(n, np.int16)
    if not n:
        return label
    if langs > BLOCK_LANGS:
        block = n  # what a block does would take langs ** 2 numbers
    size = np.diff(first)
    parts = -(-size // block)
    text = np.repeat(np.arange(len(size)), parts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[text] + place * block
    length = np.minimum(block, first[text + 1] - start)
    order = np.argsort(-length, kind="stable")
    start, length, place, text = start[order], length[order], place[order], text[order]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # blocks of more than t words
    value = np.zeros((len(start), langs), np.int64)
    if place.any():
        does = np.full((len(start), langs, langs), -(1 << 50), np.int64)
        does[:, np.arange(langs), np.arange(langs)] = 0
        for t in range(length[0]):
            m = live[t]
            does[:m] = _step(does[:m], scores[start[:m] + t][:, None, :], penalty)
        at = np.lexsort((text, place))  # the first blocks of all texts, then the second ones ...
        before = np.full(len(start), -1)
        seq = np.lexsort((place, text))
        before[seq[1:]] = np.where(text[seq[1:]] == text[seq[:-1]], seq[:-1], -1)
        cuts = np.searchsorted(place[at], np.arange(1, place.max() + 2))
        for a, z in zip(cuts, cuts[1:]):
            b = at[a:z]
            value[b] = (value[before[b]][:, :, None] + does[before[b]]).max(axis=1)
    came = np.empty((n, langs), np.int8 if langs < 128 else np.int16)
    for t in range(length[0]):
        m = live[t]
        v, rows = value[:m], start[:m] + t
        best = v.argmax(axis=1)
        top = v[np.arange(m), best][:, None] - penalty
        came[rows] = np.where(v >= top, np.arange(langs), best[:, None])
        value[:m] = np.maximum(v, top) + scores[rows]
    # from each language at the end of a block back to the one before its start, and the labels of the way that is taken
    ends = np.tile(np.arange(langs), (len(start), 1))
    if place.any():
        for t in range(length[0] - 1, -1, -1):
            m = live[t]
            ends[:m] = np.take_along_axis(came[start[:m] + t], ends[:m], axis=1)
    here = value.argmax(axis=1)
    if place.any():
        last = np.ones(len(start), bool)
        last[before[before >= 0]] = False
        b = np.flatnonzero(last)
        while len(b := b[before[b] >= 0]):
            here[before[b]] = ends[b, here[b]]
            b = before[b]
    for t in range(length[0] - 1, -1, -1):
        m = live[t]
        rows = start[:m] + t
        label[rows] = here[:m]
        here[:m] = came[rows, here[:m]]
    return label


def counts_of(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of some texts: how often each bucket has an n-gram of a word of letters, and each script a character."""
    grams, scripts = np.zeros(1 << bits, np.int64), np.zeros(len(_KINDS) + 1, np.int64)
    for part in _pieces(lowered(texts)):
        words = Words(part)
        _, at, times = np.unique(words.hashes(), return_index=True, return_counts=True)
        if not len(at):
            continue
        c = Characters([words.data[a:z] for a, z in zip(words.start[at].tolist(), words.end[at].tolist())])
        weight = times * (c.summed(letters(c.points)) == c.end - c.start - 1)  # words of letters only
        each = np.repeat(weight, c.end - c.start)
        for bucket, valid in c.grams(bits):
            m = min(len(bucket), len(each))
            np.add.at(grams, bucket[:m], each[:m] * valid[:m])
        np.add.at(scripts, c.kinds()[: len(each)], each)
    return grams, scripts[:-1]


def _pieces(texts: list[bytes], size: int = PIECE):
    """The same words in lists of about size bytes; long texts are cut between words."""
    own, held = [], 0
    for t in texts:
        at = 0
        while at < len(t):
            z = at + size
            while z < len(t) and (t[z] >= 128 or t[z : z + 1].isalnum()):
                z += 1
            own.append(t[at:z])
            held += len(own[-1])
            at = z
            if held >= size:
                yield own
                own, held = [], 0
    if own:
        yield own


def model_of(langs: tuple[str, ...], grams: np.ndarray, scripts: np.ndarray, penalty: float = 6.0) -> LanguageModel:
    """grams: (buckets, languages) counts, scripts: (scripts, languages) counts."""
    seen = max(1, int((grams.sum(axis=1) > 0).sum()))
    p = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * seen))
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    allowed = (scripts > 0) & (share >= np.minimum(SCRIPT_SHARE, share.max(axis=1, keepdims=True, initial=0)))
    return LanguageModel(langs, np.round(p * UNIT).astype(np.int16), allowed, round(penalty * UNIT))


def train(texts: dict[str, list[str]], penalty: float = 6.0) -> LanguageModel:
    """texts: of each language."""
    langs = tuple(sorted(texts))
    got = [counts_of([t.encode() for t in texts[x]], bits_for(len(langs))) for x in langs]
    if not got:
        return LanguageModel((), np.zeros((1 << 8, 0), np.int16), np.zeros((len(_KINDS), 0), bool))
    return model_of(langs, np.stack([g for g, _ in got], axis=1), np.stack([s for _, s in got], axis=1), penalty)


def fit(docs: DataFrame, per_lang: int = 400, sample_docs: int = 4000, seed: int = 42) -> LanguageModel:
    """docs(doc_id, text, lang) to learn from; see above for the sample."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang").where("doc_id is not null and lang is not null and length(text) > 0")
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_docs).collect()
    if not known:
        return train({})
    # ids first, without a task that holds a language: a document's place is about its rank by hash within its language
    size = F.broadcast(spark.createDataFrame(known, "lang string, n long"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53) * F.col("n")
    ids = rows.select("doc_id", "lang").join(size, "lang").select("doc_id", "lang", place.alias("o")).where(F.col("o") < per_lang).distinct()
    chosen = [(r.doc_id, r.lang) for r in ids.orderBy("o", "lang", "doc_id").limit(sample_docs).collect()]  # at most sample_docs pairs
    langs = tuple(sorted({x for _, x in chosen}))
    bits = bits_for(len(langs))
    number = {x: k for k, x in enumerate(langs)}
    picked = spark.createDataFrame([(d, x, number[x]) for d, x in chosen], "_d long, _l string, k int")
    sample = rows.join(F.broadcast(picked), (F.col("doc_id") == F.col("_d")) & (F.col("lang") == F.col("_l")))
    sample = sample.groupBy("doc_id", "k").agg(F.min("text").alias("text"))  # repeated rows once

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        own = b.column(0).to_numpy()
        texts = encoded(b.column(1))
        ks, js, ns = [], [], []
        for k in np.unique(own).tolist():
            grams, scripts = counts_of([texts[i] for i in np.flatnonzero(own == k)], bits)
            for j, n in ((np.flatnonzero(grams), grams), (np.flatnonzero(scripts), scripts)):
                ks.append(np.full(len(j), k))
                js.append(j if n is grams else -1 - j)
                ns.append(n[j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ks, js, ns)], names=["k", "j", "n"])

    got = map_batches(sample.select("k", "text"), each, "k long, j long, n long").groupBy("k", "j").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((1 << bits, len(langs)), np.int64), np.zeros((len(_KINDS), len(langs)), np.int64)
    k, j, n = (got[c].to_numpy(np.int64) for c in ("k", "j", "n"))
    grams[j[j >= 0], k[j >= 0]] = n[j >= 0]
    scripts[-1 - j[j < 0], k[j < 0]] = n[j < 0]
    return model_of(langs, grams, scripts)


def _scored(texts: list[bytes], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of all words, letters of each, index of each text's first word and the end)."""
    first, scores, n = [0], [], []
    for t in lowered(texts):
        here = 0
        for part in _pieces([t]):
            words = Words(part)
            here += len(words.start)
            if len(words.start):
                _, at, inv = np.unique(words.hashes(), return_index=True, return_inverse=True)
                s, k = word_scores([words.data[a:z] for a, z in zip(words.start[at].tolist(), words.end[at].tolist())], model)
                scores.append(s[inv])
                n.append(k[inv])
        first.append(first[-1] + here)
    if not scores:
        return np.zeros((0, len(model.langs)), np.int16), np.zeros(0, np.int64), np.array(first)
    return np.concatenate(scores), np.concatenate(n), np.array(first)


def identify(docs: DataFrame, model: LanguageModel, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of each row, and with spans the labelled runs of words as (start, end, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** MODEL_BITS numbers of 16 bits

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts = encoded(b.column(1))
        n, runs = len(texts), [[] for _ in texts]
        lang, score = ["und"] * n, np.zeros(n)
        if m.langs:
            s, n_letters, first = _scored(texts, m)
            label = viterbi(s, first, m.penalty)
            doc = np.repeat(np.arange(n), np.diff(first))
            weight = np.zeros((n, len(m.langs)), np.int64)
            np.add.at(weight, (doc, label), n_letters)
            total, best = weight.sum(1), weight.argmax(1)
            for k in np.flatnonzero(total).tolist():
                lang[k], score[k] = m.langs[best[k]], weight[k, best[k]] / total[k]
                if spans:
                    own = label[first[k] : first[k + 1]]
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                    runs[k] = [{"start": a, "end": z, "lang": m.langs[own[a]]} for a, z in zip(cuts, cuts[1:]) if z > a]
        out = [b.column(0), pa.array(lang), pa.array(score)]
        if spans:
            out.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<start: long, end: long, lang: string>>" if spans else "")
    return map_batches(pick(docs, doc_id="doc_id", text="text"), each, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32 of doc_id isn't 2 modulo 4, predicts all."""
    docs = pick(docs, doc_id="doc_id", text="text", lang="lang")
    fold = F.pmod(crc_of_id("doc_id"), F.lit(4))
    model = fit(docs.where(fold != 2))
    return identify(docs, model).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
