"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for each bit that over half of its shingles'
hashes have. Equal fingerprints fold to one row first, however many copies there
are. The rest are dealt to tiles by their population counts - of the whole
fingerprint, or of its halves, quarters or bytes when there are more of them -
and cut in blocks of bounded size. Two fingerprints whose population counts
differ by more than the radius (summed over the parts) differ in more bits than
the radius, so only tile pairs within it are compared, bit by bit, with numpy's
exclusive-or and bit count. A block pair emits a star per group it finds, never
all pairs; components are found on these edges.

Edge cases: a null, empty or blank text has fingerprint zero and links like any
other; a text of one or two words has the one shingle of its whole sequence;
long texts are hashed whole, in pieces; repeated rows of a doc_id are one
document; a row without doc_id has a fingerprint and takes the smallest doc_id
of its component (null if there is none); extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, encoded, map_batches, numbered, pick, place_of, written
from tidemark.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints in a block, about.
BLOCK = 1024
PIECE = 1 << 16

#: For each byte, its bits as the bytes of one 64-bit word, lowest bit first.
_SPREAD = np.packbits(np.zeros((256, 64), np.uint8), axis=1).view(np.uint64).ravel().copy()
for _i in range(256):
    _SPREAD[_i] = sum(((_i >> j) & 1) << (8 * j) for j in range(8))


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """hashes: 64-bit values of consecutive groups; first: where each group starts (none is empty). (groups, 64) counts of set bits."""
    size = np.diff(np.append(first, len(hashes)))
    parts = -(-size // 255)  # sums of up to 255 bits fit a byte
    own = np.repeat(np.arange(len(first)), parts)
    step = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = first[own] + 255 * step
    raw = hashes.view(np.uint8).reshape(-1, 8)
    out = np.empty((len(first), 64), np.int64)
    group = np.cumsum(parts) - parts
    for p in range(8):
        sums = np.add.reduceat(_SPREAD[raw[:, p]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[:, 8 * p : 8 * p + 8] = np.add.reduceat(sums, group, axis=0)
    return out


def shingle_hashes(text: bytes):
    """XXH64 values of a text's shingles, in arrays of at most PIECE values."""
    words = text.lower().split()
    if not words:
        return
    if len(words) < SHINGLE:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - SHINGLE + 1].tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), PIECE):
        part = [digest(whole[a:b], SEED) for a, b in zip(starts[i : i + PIECE], stops[i : i + PIECE])]
        yield np.array(part, np.uint64)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts."""
    counts = np.zeros((len(texts), 64), np.int64)
    n = np.zeros(len(texts), np.int64)
    held, owner, held_n = [], [], 0

    def flush():
        nonlocal held, owner, held_n
        if held:
            first = np.concatenate(([0], np.cumsum([len(h) for h in held])[:-1]))
            np.add.at(counts, owner, bit_counts(np.concatenate(held), first))
            held, owner, held_n = [], [], 0

    for k, t in enumerate(texts):
        for part in shingle_hashes(t):
            held.append(part)
            owner.append(k)
            n[k] += len(part)
            held_n += len(part)
            if held_n > 1 << 18:
                flush()
    flush()
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints_of(encoded(b.column(1))).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return map_batches(pick(docs, doc_id="doc_id", text="text"), each, "doc_id long, fp long")


def parts_for(n: int) -> int:
    """Of how many equal parts of the fingerprint the tiles hold population counts: the largest tiles stay of some thousand rows."""
    return 1 if n < 20_000 else 2 if n < 1_000_000 else 4 if n < 60_000_000 else 8


def _tile_code(fp, parts: int):
    """The population counts of the parts as digits of one long."""
    width = 64 // parts
    code = F.lit(0).cast("long")
    for i in range(parts):
        part = F.shiftrightunsigned(fp, i * width)
        if width < 64:
            part = part.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        code = code * 128 + F.bit_count(part).cast("long")
    return code


def _steps(parts: int, radius: int) -> list[int]:
    """Differences of tile codes within the radius, of either sign one; 0 too."""
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=parts) if parts <= 4 else _sparse_steps(parts, radius):
        if sum(map(abs, d)) <= radius:
            code = 0
            for x in d:
                code = code * 128 + x
            if code >= 0:
                out.append(code)
    return sorted(set(out))


def _sparse_steps(parts: int, radius: int):
    def grow(at: int, left: int):
        if at == parts:
            yield ()
            return
        for x in range(-left, left + 1):
            for rest in grow(at + 1, left - abs(x)):
                yield (x, *rest)

    yield from grow(0, radius)


def _stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest id of their group, for links i-j between positions of ids."""
    rank = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[rank] = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[rank[new]])
        if np.array_equal(new, label):
            break
        label = new
    node = np.flatnonzero(rank[label] != np.arange(len(ids)))
    return ids[node], ids[rank[label[node]]]


def compare(fa: np.ndarray, ia: np.ndarray, fb: np.ndarray, ib: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the rows of two blocks (fingerprints and ids): one star per group found."""
    rows, cols = [], []
    for k in range(0, len(fa), 256):
        r, c = np.nonzero(np.bitwise_count(fa[k : k + 256, None] ^ fb[None, :]) <= radius)
        rows.append(r + k)
        cols.append(c)
    i, j = np.concatenate(rows), np.concatenate(cols)
    keep = ia[i] != ib[j]
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, at = np.unique(np.concatenate((ia[i[keep]], ib[j[keep]])), return_inverse=True)
    return _stars(ids, at[: keep.sum()], at[keep.sum() :])


def links(distinct: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """distinct(fp, node), each fp once -> edges (u, v) that join all fp within the radius of each other."""
    parts = parts or parts_for(distinct.count())
    coded = distinct.where("node is not null").withColumn("tile", _tile_code(F.col("fp"), parts))
    packed = (
        dealt(coded, ["tile"], BLOCK, "fp")
        .groupBy("tile", "block")
        .agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("rows"))
        .select("tile", "block", F.col("rows.fp").alias("fps"), F.col("rows.node").alias("nodes"))
    )
    blocks = written(packed, "blocks")
    names = blocks.select("tile", "block")
    near = names.select(F.col("tile").alias("ta"), F.col("block").alias("ba"), F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(parts, radius)])).alias("d"))
    other = names.select(F.col("tile").alias("tb"), F.col("block").alias("bb"))
    pairs = near.withColumn("tb", F.col("ta") + F.col("d")).join(other, "tb").where("d > 0 or ba <= bb").select("ta", "ba", "tb", "bb")
    pairs = written(pairs, "tile_pairs")
    left = blocks.select(F.col("tile").alias("ta"), F.col("block").alias("ba"), F.col("fps").alias("fa"), F.col("nodes").alias("ia"))
    right = blocks.select(F.col("tile").alias("tb"), F.col("block").alias("bb"), F.col("fps").alias("fb"), F.col("nodes").alias("ib"))
    both = pairs.join(left, ["ta", "ba"]).join(right, ["tb", "bb"]).select("fa", "ia", "fb", "ib")

    def each(b: pa.RecordBatch) -> pa.RecordBatch | None:
        us, vs = [], []
        for k in range(b.num_rows):
            fa, ia, fb, ib = (b.column(c)[k].values.to_numpy() for c in range(4))
            u, v = compare(fa.view(np.uint64), ia, fb.view(np.uint64), ib, radius)
            us.append(u)
            vs.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return map_batches(both, each, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of docs."""
    fps = written(fingerprint(docs), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    found = components(links(distinct, radius, parts))
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component (rows without doc_id stay)."""
    found = near_duplicates(docs, radius)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return numbered(docs).join(gone, F.col(f"_{place_of(docs, 'doc_id')}") == F.col("gone_id"), "left_anti").toDF(*docs.columns)
