"""Benchmark decontamination by winnowing.

Of the hashes of a text's k-grams of words, the smallest in each window of w is
kept (the last of equals). Two texts that share t = k + w - 1 words in a row
share a whole window and so a kept hash: nothing of t words is missed. Items of
at least ten words use k = 5, w = 6; shorter items use a level of their own, so
that one occurrence of the whole item is found just as surely.

Documents are read once. A bitmap of the items' fingerprints (its size is fixed
by a parameter, however many there are) drops nearly all of the documents'
fingerprints where they arise; the rest carry the few words around them, are
joined with the items' fingerprints by hash, compared word by word and extended
to the shared run. The items' side is broadcast up to a counted number of rows
and joined by a shuffle beyond it.

Edge cases: null or empty texts have no words and no hits; an item without
words takes no part; items of equal text each count; repeated rows of documents
are judged one by one; a null item_id is left out; long texts are cut in pieces
that overlap by t - 1 words; extra columns are ignored; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_TABLE, Words, encoded, grams, map_batches, mix, pick, without, written

WINDOW = 10
GRAM = 5
#: Bytes of text handled at once.
PIECE = 1 << 20
#: The items' fingerprints are broadcast up to so many rows (of some 200 bytes), and shuffled beyond.
BROADCAST_ROWS = 100_000
#: The bitmap has so many bits a fingerprint, and 2 ** 26 bits (8 MB) at most.
BITS_EACH, MOST_BITS = 2048, 26


def level_of(n_words: int, window: int = WINDOW) -> int:
    return min(n_words, window)


def gram_of(level: int) -> int:
    return min(GRAM, level)


def select(gram_hash: np.ndarray, allowed: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash (last of equals) of each window of w grams; allowed: where a window may start."""
    n = len(gram_hash) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = gram_hash[:n].copy()
    at = np.arange(n)
    for i in range(1, w):
        nxt = gram_hash[i : i + n]
        later = nxt <= low
        low = np.where(later, nxt, low)
        at = np.where(later, np.arange(i, i + n), at)
    return np.unique(at[allowed[:n]])


def fingerprints(words: Words, hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept k-grams of all texts, for shared runs of at least level words."""
    k = gram_of(level)
    g = mix(grams(hashes, k) + np.uint64(level))
    n = len(words.start)
    left = words.first[1:][words.doc] - np.arange(n)  # words from here to the text's end
    at = select(g, left >= level, level - k + 1)
    return at, g[at]


def pieces(text: bytes, overlap: int, size: int = PIECE) -> Iterator[tuple[bytes, int]]:
    """(part, index of its first word): parts of about size bytes that share overlap words."""
    if len(text) <= size:
        yield text, 0
        return
    text = text.translate(WORD_TABLE)
    start = offset = 0
    while True:
        cut = text.find(b" ", start + size) if start + size < len(text) else -1
        while cut >= 0 and len(text[start:cut].split(None, overlap)) <= overlap:  # too few words to go on from
            cut = text.find(b" ", cut + size) if cut + size < len(text) else -1
        part = text[start:] if cut < 0 else text[start:cut]
        yield part, offset
        if cut < 0:
            return
        n = len(part.split())
        tail = len(part)
        for word in reversed(part.rsplit(None, overlap)[-overlap:] if overlap else []):  # walk back over the overlap
            tail = part.rindex(word, 0, tail)
        start, offset = start + tail, offset + n - overlap


def item_fingerprints(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, level, lead, ctx, items): kept k-grams of the items with the words around them, equal ones as one row."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for item, text in zip(b.column(0).to_pylist(), encoded(b.column(1))):
            text = b" ".join(text.translate(WORD_TABLE).split())
            level = level_of(text.count(b" ") + 1, window) if text else 0
            for part, _ in pieces(text, window - 1):
                words = Words([part])
                n = len(words.start)
                if n < max(1, level):
                    continue
                at, h = fingerprints(words, words.hashes(), level)
                for p, x in zip(at.tolist(), h.view(np.int64).tolist()):
                    a = max(0, p - (level - gram_of(level)))
                    for col, v in zip(out, (x, level, p - a, words.text(a, min(n, p + level)).decode("utf-8", "replace"), item)):
                        col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())], names=["h", "level", "lead", "ctx", "item_id"])

    rows = map_batches(pick(benchmark, item_id="item_id", text="text").where("item_id is not null and text is not null"), each, "h long, level int, lead int, ctx string, item_id long")
    return rows.groupBy("h", "level", "lead", "ctx").agg(F.collect_set("item_id").alias("items"))


def bitmap(fps: DataFrame, n: int) -> np.ndarray:
    """A bit for each of 2 ** b values of the hashes' top bits."""
    b = int(min(MOST_BITS, max(20, np.ceil(np.log2(max(1, n) * BITS_EACH)))))
    top = F.shiftrightunsigned("h", 64 - b)
    words = fps.select(F.shiftright(top, 5).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - b}) & 31 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros((1 << b) // 32, np.uint32)
    got = words.toPandas()  # at most 2 ** 21 rows, whatever the size of the benchmark
    out[got.w.to_numpy(np.int64)] = got.bits.to_numpy(np.int64).astype(np.uint32)
    return out


def _candidates(docs: DataFrame, bits: np.ndarray, levels: list[int], window: int) -> DataFrame:
    """(rid, doc_id, key, n_words, cands): each row of docs with its fingerprints that the bitmap lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    b = np.uint64(64 - (int(np.log2(len(bits))) + 5))
    kind = pa.struct([("h", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("lead", pa.int32()), ("ctx", pa.string())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, owner, offset = [], [], []
        for k, t in enumerate(encoded(batch.column(2))):
            for part, at in pieces(t, window - 1):
                parts.append(part)
                owner.append(k)
                offset.append(at)
        words = Words(parts)
        own, off = np.array(owner), np.array(offset)
        n_words = np.zeros(batch.num_rows, np.int64)
        np.maximum.at(n_words, own, off + np.diff(words.first))
        found: list[tuple] = []
        if len(words.start) and levels:
            hashes, filt = words.hashes(), shared.value
            for level in levels:
                at, h = fingerprints(words, hashes, level)
                top = h >> b
                hit = (filt[(top >> np.uint64(5)).astype(np.int64)] >> (top & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
                side = level - gram_of(level)
                for p, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist()):
                    d = words.doc[p]
                    a, z = max(words.first[d], p - side), min(words.first[d + 1], p + level)
                    found.append((owner[d], {"h": x, "level": level, "pos": int(off[d] + p - words.first[d]), "lead": int(p - a), "ctx": words.text(a, z).decode("utf-8", "replace")}))
        found.sort(key=lambda x: x[0])
        sizes = np.bincount([k for k, _ in found], minlength=batch.num_rows) if found else np.zeros(batch.num_rows, np.int64)
        cands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array([c for _, c in found], kind))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n_words), cands], names=["rid", "doc_id", "key", "n_words", "cands"])

    rows = pick(docs, doc_id="doc_id", text="text").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.xxhash64("text").alias("key"))
    return map_batches(rows, each, "rid long, doc_id long, key long, n_words long, cands array<struct<h: long, level: int, pos: long, lead: int, ctx: string>>")


def extend(level: int, a: list[str], i: int, b: list[str], j: int) -> tuple[int, int] | None:
    """How far words a from i and b from j agree to either side, as (words before, words from i on), or None if under level."""
    left = right = 0
    while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
        left += 1
    most = min(len(a) - i, len(b) - j)
    while right < most and a[i + right] == b[j + right]:
        right += 1
    return (left, right) if right >= gram_of(level) and left + right >= level else None


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of each row of docs: doc_id, n_words, n_hit, n_items, items (ids, sorted as strings), spans (hit words as
    [start, end) pairs, merged), contaminated, and key (a hash of the text)."""
    fps = written(item_fingerprints(benchmark, window), "item_fps")
    levels = sorted(r.level for r in fps.select("level").distinct().collect())  # at most ten numbers
    n = fps.count()
    staged = written(_candidates(docs, bitmap(fps, n), levels, window), "candidates")
    cands = staged.where(F.size("cands") > 0).select("rid", F.explode("cands").alias("c")).select("rid", "c.*")
    items = fps.select("h", "level", F.col("lead").alias("ilead"), F.col("ctx").alias("ictx"), "items")
    joined = cands.join(F.broadcast(items) if n <= BROADCAST_ROWS else items.hint("merge"), ["h", "level"])

    def each(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rid, start, end, ids = [], [], [], []
        d = b.to_pydict()
        for r, lv, pos, lead, ctx, ilead, ictx, own in zip(*(d[c] for c in ("rid", "level", "pos", "lead", "ctx", "ilead", "ictx", "items"))):
            if got := extend(lv, ctx.split(" "), lead, ictx.split(" "), ilead):
                rid.append(r)
                start.append(pos - got[0])
                end.append(pos + got[1])
                ids.append(own)
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["rid", "start", "end", "items"])

    hits = map_batches(joined.select("rid", "level", "pos", "lead", "ctx", "ilead", "ictx", "items"), each, "rid long, start long, end long, items array<long>")
    by_doc = hits.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    merged = F.expr(
        """aggregate(runs, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, x) ->
             case when size(acc) > 0 and element_at(acc, -1).end >= x.start
                  then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
                  else concat(acc, array(named_struct('start', x.start, 'end', x.end))) end)"""
    )
    by_doc = by_doc.select("rid", F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"), merged.alias("spans"))
    out = staged.select("rid", "doc_id", "key", "n_words").join(by_doc, "rid", "left")
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.end - x.start)"), F.lit(0).cast("long"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"), (n_hit > 0).alias("contaminated"), "key")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """report() with the items as the SHA-256 of their comma-joined ids."""
    r = report(docs, benchmark)
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a word of a benchmark window, with docs' columns."""
    return without(docs, report(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")))
