"""The registered queries over the whole tables of sf0.01, against brute force, an exact round trip or held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from tidemark.llm import decontaminate, neighbours, simhash
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pydict()


def brute_hits(texts, items, window=10):
    by = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            by.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = sorted({len(x) for x in by})
    for d, t in texts:
        w = words(t)
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := by.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    own |= found
        yield d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)


def test_op3(spark):
    d, b = table("documents"), table("benchmark")
    want = sorted(brute_hits(zip(d["doc_id"], d["text"]), zip(b["item_id"], b["text"])))
    got = sorted(tuple(r) for r in QUERIES["op3_benchmark_decontamination"](spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == want and sum(x[-1] for x in want) > 10


@pytest.mark.parametrize("piece", [40, 200, 1 << 22])
def test_op3_pieces_of_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(decontaminate.pieces, "__defaults__", (piece,))
    rng = np.random.default_rng(1)
    some = [f"w{i}" for i in range(6)] + ["averyveryverylongword" * 5]
    items = [(i, " ,  ".join(rng.choice(some, n))) for i, n in enumerate((1, 3, 9, 10, 11, 40, 120))] + [(50, "   . . ." * 50), (51, "x " + " " * 300)]
    texts = [(i, " ".join(rng.choice(some, 300)) + " . " * 30) for i in range(6)] + [(7, items[5][1] * 3), (8, "")]
    got = decontaminate.digest(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_hits(texts, items))


@pytest.mark.parametrize("parts", [None, 2, 4, 8])
def test_op4(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "BLOCK", 16 if parts else 1024)
    d = table("documents")
    fps = []
    for t in d["text"]:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64)
        fps.append(sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(s)))
    fp = np.array(fps, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    label = np.array(d["doc_id"])
    while True:
        new = np.array([label[x].min() for x in near])
        if (new == label).all():
            break
        label = new
    got = {tuple(r) for r in simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), parts=parts).collect()}
    assert got == {(i, f"{x:016x}", int(c)) for i, x, c in zip(d["doc_id"], fps, label)}


@pytest.mark.parametrize("block", [8, 2048])
def test_op2(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    t = table("embeddings")
    own = [k for k, v in enumerate(t["embedding"]) if v is not None and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    x, i = np.array([t["embedding"][k] for k in own], float), np.array([t["vec_id"][k] for k in own])
    got = QUERIES["op2_approximate_neighbours"](spark, SF).toPandas()
    hit = total = 0
    for q in np.flatnonzero(i % 20 == 0):
        s = x @ x[q]
        want = [k for k in np.lexsort((i, -s)) if k != q][:20]
        mine = got[got.query_id == i[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(want) + 1))
        hit += len(set(i[want]) & set(mine.vec_id))
        total += len(want)
    assert hit >= 0.9 * total


def test_op2_short_lists_and_double_vectors(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((200, 6)), 40 + 0.01 * rng.standard_normal((5, 6))])  # five far away have buckets of their own
    rows = [(k, v.tolist(), 1, "z") for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, VEC_ID int, rank string").repartition(3)
    got = neighbours.search(df, df).toPandas()
    s = x @ x.T
    assert np.allclose(got.score, s[got.query_id, got.vec_id], rtol=0, atol=0) or np.allclose(got.score, s[got.query_id, got.vec_id], rtol=1e-14)
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 205
    want = {q: set([k for k in np.lexsort((np.arange(205), -s[q])) if k != q][:20]) for q in range(205)}
    assert np.mean([len(want[q] & set(d.vec_id)) / 20 for q, d in got.groupby("query_id")]) >= 0.9


def test_op2_scan_of_all_blocks_is_exact(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 5))
    blocks = spark.createDataFrame([(list(range(a, a + 60)), x[a : a + 60].ravel().tolist()) for a in range(0, 300, 60)], "nodes array<long>, vecs array<double>").repartition(1)
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 300, 7)], "node long, vec array<double>")
    got = neighbours._scanned(blocks, queries, 20).toPandas()
    for k, d in got.groupby("q"):
        s = x @ x[k]
        assert d.sort_values(["score", "node"], ascending=[False, True]).node.tolist() == np.lexsort((np.arange(300), -s))[:21].tolist()


def test_op10_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.1").where("held_out").collect()}
    t = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pydict()
    known = [(got[d], q) for d, q in zip(t["doc_id"], t["quality"]) if d in got and q is not None and zlib.crc32(str(d).encode()) % 5 == 0]
    s, q = np.array([r.score for r, _ in known]), np.array([q for _, q in known])
    auc = np.mean(s[q == 1][:, None] > s[q == 0][None, :]) + 0.5 * np.mean(s[q == 1][:, None] == s[q == 0][None, :])
    assert len(known) > 200 and auc > 0.98 and np.mean([r.predicted == y for r, y in known]) > 0.95
