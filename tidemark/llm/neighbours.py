"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are divided by the largest norm and get one component more that makes
them of length one, so that the largest inner product is the smallest distance.
Each of several tables hashes them by floor((a . x + b) / w) for a few Gaussian a.
A query visits its own bucket and then perturbed ones, in the order of their
estimated success (by expected squared distance to the crossed boundaries). The
width and the number of visits are fitted on a bounded sample: buckets widen until the visits reach RECALL there
(in the end all rows are in few buckets); the index holds every row.

Equal vectors are one class, of which only the TOP + 1 smallest ids can ever be
asked for. Buckets and the queries that visit them are packed in blocks of
bounded size; a pair of blocks is one matrix product in double precision that
gives each query its best few, so no pair of rows becomes a row. A hot bucket is
many blocks, dealt over tasks.

Edge cases: vectors null, empty, zero, of another length than most, or with null
or non-finite components take no part, as queries or candidates; ties go to the
smaller vec_id; repeated rows of an id count once; queries without any candidate have no row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, limit_batches, map_batches, pick, written

TOP = 20
TABLES = 2
RECALL = 0.97
#: Rows from which tables and visits are fitted, and queries tried on them, at most.
SAMPLE, TRIED = 6000, 200
BLOCK, QUERY_BLOCK, PASS = 2048, 512, 2048


@dataclass(frozen=True)
class Hashing:
    norm: float
    a: np.ndarray  # (tables, hashes, dimension + 1)
    b: np.ndarray  # (tables, hashes)
    w: float
    visits: int
    recall: float = 0.0  # on the sample

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, hashes), in units of a bucket's width."""
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.norm)
        last = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1, keepdims=True)))
        return np.einsum("nd,tkd->ntk", np.hstack([x, last]), self.a) / self.w + self.b


def perturbations(k: int, most: int) -> list[list[int]]:
    """Sets of ranks (0 to 2k - 1, boundaries from near to far; r and 2k - 1 - r are the two sides of one hash), likely ones first."""
    j = np.arange(1, 2 * k + 1, dtype=float)
    far = 2 * k + 1 - j
    cost = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)), 1 - far / (k + 1) + far * (far + 1) / (4 * (k + 1) * (k + 2)))
    out: list[list[int]] = [[]]
    heap = [(cost[0], [0])]
    while heap and len(out) < most:
        c, s = heapq.heappop(heap)
        if all(2 * k - 1 - r not in s for r in s):
            out.append(s)
        if s[-1] + 1 < 2 * k:
            heapq.heappush(heap, (c - cost[s[-1]] + cost[s[-1] + 1], [*s[:-1], s[-1] + 1]))
            heapq.heappush(heap, (c + cost[s[-1] + 1], [*s, s[-1] + 1]))
    return out


def visited(y: np.ndarray, sets: list[list[int]]) -> np.ndarray:
    """y: (rows, hashes) projections of one table -> (rows, visits, hashes) buckets, the own one first."""
    n, k = y.shape
    own = np.floor(y).astype(np.int64)
    frac = y - own
    rank = np.argsort(np.hstack([frac, 1 - frac]), axis=1, kind="stable")
    out = np.repeat(own[:, None, :], len(sets), axis=1)
    rows = np.arange(n)
    for p, s in enumerate(sets):
        for r in s:
            side = rank[:, r]
            out[rows, p, side % k] += np.where(side < k, -1, 1)
    return out


def codes(buckets: np.ndarray) -> np.ndarray:
    """One long per bucket: its coordinates mixed."""
    h = np.zeros(buckets.shape[:-1], np.uint64)
    for i in range(buckets.shape[-1]):
        h = (h ^ buckets[..., i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def fit(classes: DataFrame, n: int, norm: float, seed: int = 7) -> Hashing:
    """The hashing, fitted on at most SAMPLE vectors: hashes by the number of rows, width by spread, visits by recall."""
    got = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vec").collect()
    x = np.array([r.vec for r in got], float)
    k = int(np.clip(round(np.log(max(n, 2) / 2000) / np.log(3)), 3, 12))
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((TABLES, k, x.shape[1] + 1))
    h = Hashing(norm, a, rng.random((TABLES, k)), 1.0, 1)
    w = 2 * float(np.std(h.project(x, False) - h.b, axis=0).mean()) or 1.0
    q = x[:TRIED]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argsort(-s, axis=1)[:, : min(TOP, max(1, len(x) - 1))]
    most = 3**k if k <= 7 else 4000
    sets = perturbations(k, most)
    while True:  # wider buckets until the visits reach enough
        h = Hashing(norm, a, h.b, w, len(sets))
        reach = _reach(h, x, q, true, sets)
        good = np.flatnonzero(reach >= RECALL)
        if len(good):
            return Hashing(norm, a, h.b, w, int(good[0]) + 1, float(reach[good[0]]))
        w *= 1.5


def _reach(h: Hashing, x: np.ndarray, q: np.ndarray, true: np.ndarray, sets: list[list[int]]) -> np.ndarray:
    """The share of the true neighbours that 1, 2, ... visits find."""
    home, probe = np.floor(h.project(x, False)).astype(np.int64), h.project(q, True)
    first = np.full(true.shape, len(sets))
    for t in range(TABLES):
        v, own = codes(visited(probe[:, t], sets)), codes(home[:, t])
        for i in range(len(q)):
            at = {c: p for p, c in reversed(list(enumerate(v[i].tolist())))}
            first[i] = np.minimum(first[i], [at.get(int(c), len(sets)) for c in own[true[i]]])
    return np.array([(first < p).mean() for p in range(1, len(sets) + 1)])


def _hashed(rows: DataFrame, h: Hashing, query: bool) -> DataFrame:
    """(t, bucket, node, vec): each row once per table, or per table and visit."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(h)
    sets = perturbations(h.a.shape[1], h.visits) if query else [[]]

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        flat = b.column(1).flatten().to_numpy().astype(float)
        y = m.project(flat.reshape(b.num_rows, -1), query)
        c = np.stack([codes(visited(y[:, t], sets)) for t in range(TABLES)], axis=1).reshape(b.num_rows, -1)
        arr = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * c.shape[1], pa.int32()), pa.array(c.ravel()))
        return pa.RecordBatch.from_arrays([*b.columns, arr], names=["node", "vec", "buckets"])

    out = map_batches(rows.select("node", "vec"), each, f"node long, vec {rows.schema['vec'].dataType.simpleString()}, buckets array<long>")
    out = out.select("node", "vec", F.posexplode("buckets").alias("p", "bucket"))
    return out.select((F.col("p") / len(sets)).cast("int").alias("t"), "bucket", "node", "vec")


def _packed(rows: DataFrame, size: int, tag: str) -> DataFrame:
    """(t, bucket, nodes, vecs): blocks of about size rows of a bucket."""
    cut = dealt(rows, ["t", "bucket"], size, "node")
    got = cut.groupBy("t", "bucket", "block").agg(F.collect_list(F.struct("node", "vec")).alias("x"))
    return written(got.select("t", "bucket", F.col("x.node").alias("nodes"), F.flatten("x.vec").alias("vecs")), tag)


def best_of(scores: np.ndarray, nodes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's best columns: largest score, then smallest node."""
    n = scores.shape[1]
    if n > top:
        kth = -np.partition(-scores, top - 1, axis=1)[:, top - 1]
        r, c = np.nonzero(scores >= kth[:, None])
    else:
        r, c = np.nonzero(np.ones_like(scores, bool))
    order = np.lexsort((nodes[c], -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < top], c[place < top]


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """vectors(vec_id, embedding), queries(vec_id, embedding): query_id, rank, vec_id, score of each query's nearest rows but its own id."""

    single = all(pick(df, vec="embedding").schema["vec"].dataType.simpleString() == "array<float>" for df in (vectors, queries))
    kind = "array<float>" if single else "array<double>"

    def valid(df: DataFrame) -> DataFrame:
        df = pick(df, vec_id="vec_id", vec="embedding").withColumn("vec", F.col("vec").cast(kind))
        fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & fine & F.exists("vec", lambda x: x != 0))

    rows = valid(vectors)
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes[0].d
    # the few smallest ids of each distinct vector, each id once; the limit holds before the shuffle by vector
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    ids = rows.where(F.size("vec") == d).distinct().withColumn("place", place).where(F.col("place") <= top + 1)
    classes = ids.groupBy("vec").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = written(classes, "vector_classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("m")).first()
    h = fit(classes, facts.n, float(np.sqrt(facts.m)) * (1 + 1e-9))
    asked = written(valid(queries).where(F.size("vec") == d).select("vec_id", F.col("vec")).distinct(), "queries")
    askers = written(asked.groupBy("vec").agg(F.min("vec_id").alias("node")), "query_classes")
    blocks = _packed(_hashed(classes, h, False), BLOCK, "buckets")
    visits = _packed(_hashed(askers, h, True), QUERY_BLOCK, "visits")
    both = visits.select("t", "bucket", F.col("nodes").alias("qn"), F.col("vecs").alias("qv")).join(blocks, ["t", "bucket"]).select("qn", "qv", "nodes", "vecs")

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        qs, ns, ss = [], [], []
        for i in range(b.num_rows):
            qn, qv, n, v = (b.column(c)[i].values.to_numpy() for c in range(4))
            s = np.einsum("qd,nd->qn", qv.reshape(len(qn), -1).astype(float), v.reshape(len(n), -1).astype(float), optimize=True)
            r, c = best_of(s, n, top + 1)
            qs.append(qn[r])
            ns.append(n[c])
            ss.append(s[r, c])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (qs, ns, ss)], names=["q", "node", "score"])

    def ranked(pairs: DataFrame, tag: str) -> DataFrame:
        return _ranked(map_batches(pairs, each, "q long, node long, score double"), classes, top, tag)

    near = ranked(both, "nearest")
    # queries whose buckets held too few rows go over all blocks
    enough = min(top + 1, classes.select(F.sum(F.size("ids"))).first()[0])
    met = near.groupBy("q").count().where(F.col("count") >= enough)
    short = askers.join(met, askers.node == met.q, "left_anti")
    n_short = (short := written(short, "short_queries")).count()
    passes = -(-n_short // (PASS // 2))  # a pass of a hash's remainder stays below PASS
    for k in range(passes):
        part = short.where(F.pmod(F.xxhash64("node"), F.lit(passes)) == k)
        hits = _scanned(blocks.where("t = 0"), part, top)
        near = near.join(part.select(F.col("node").alias("q")), "q", "left_anti").unionByName(_ranked(hits, classes, top, "nearest_again"))
    own = asked.join(askers.withColumnRenamed("node", "q"), "vec").select(F.col("vec_id").alias("query_id"), "q")
    lists = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))  # top + 1 at most
    out = own.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _scanned(blocks: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(q, node, score): each query's best of all blocks that a task reads. queries: a bounded number, broadcast."""
    got = queries.select("node", "vec").collect()
    qn, qv = np.array([r.node for r in got], np.int64), np.array([r.vec for r in got], float)
    shared = queries.sparkSession.sparkContext.broadcast((qn, qv))
    limit_batches(queries.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qn, qv = shared.value
        best_s, best_n = np.full((len(qn), 0), -np.inf), np.zeros((len(qn), 0), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                n, v = (b.column(c)[i].values.to_numpy() for c in range(2))
                s = np.hstack([best_s, np.einsum("qd,nd->qn", qv, v.reshape(len(n), -1).astype(float), optimize=True)])
                n = np.hstack([best_n, np.tile(n, (len(qn), 1))])
                order = np.lexsort((n, -s), axis=1)[:, : top + 1]
                best_s, best_n = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
        if best_s.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qn, best_s.shape[1])), pa.array(best_n.ravel()), pa.array(best_s.ravel())], names=["q", "node", "score"])

    return blocks.select("nodes", "vecs").mapInArrow(each, "q long, node long, score double")


def _ranked(hits: DataFrame, classes: DataFrame, top: int, tag: str) -> DataFrame:
    """hits(q, node, score) -> each query's top + 1 nearest ids (q, vec_id, score, place)."""
    found = hits.groupBy("q", "node").agg(F.max("score").alias("score"))
    by = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    found = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top + 1).drop("place")
    near = found.join(classes.select("node", F.explode("ids").alias("vec_id")), "node")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return written(near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top + 1).select("q", "vec_id", "score", "place"), tag)


def digest(embeddings: DataFrame) -> DataFrame:
    rows = pick(embeddings, vec_id="vec_id", embedding="embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
