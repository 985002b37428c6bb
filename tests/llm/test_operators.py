import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, licenses, lines, mixing, neighbours, quality, simhash

DOC = "doc_id long, text string, lang string, source string, Text_ int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], DOC).repartition(2)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[7] = x[3]
    x[40] = x[20]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [1.0], 0)]
    got = neighbours.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).toPandas()
    hit = 0
    for q in range(0, 300, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own.score, s[own.vec_id])
        hit += len(set(want) & set(own.vec_id))
    assert set(got.query_id) == set(range(0, 300, 20)) and hit >= 0.9 * 300


def test_neighbours_of_a_repeated_row(spark):
    x = np.random.default_rng(4).standard_normal((40, 8))
    rows = [(1, [1.0] * 8)] * 25 + [(i, [1.0] * 8) for i in range(2, 6)] + [(100 + i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.search(vectors, vectors.where("vec_id = 3")).orderBy("rank").collect()
    assert len(got) == 20 and {1, 2, 4, 5} <= {r.vec_id for r in got}


def test_lines_against_brute_force(spark):
    long, other = "This line is long enough to be counted as one.", "é" * 40
    rows = [(i, f"own {i}\n  {long if i % 2 else long.upper()}\t\n{other if i < 4 else ''}", "en") for i in range(8)] + [(20, None, None), (21, "", None), (22, long + "\n" + long, None)]
    got = {r.doc_id: r for r in lines.drop_repeats(docs(spark, rows)).collect()}
    assert (got[0].n_lines, got[0].n_dropped, got[0].kept) == (3, 1, f"own 0\n{other}")
    assert (got[20].n_lines, got[20].n_dropped, got[20].kept) == (1, 0, "")
    assert got[22].n_dropped == 0 and len(got) == len(rows)


def test_line_store_compacts(spark):
    store = lines.LineStore(spark, fanout=2)
    for k in range(5):
        fresh = store.add(spark.createDataFrame([(k, 1, 1), (k, 10 + k, 1)], "doc_id long, h1 long, h2 long")).count()
        assert fresh == (2 if k == 0 else 1)
    assert all(len(x) < 2 for x in store.levels)
    assert {(r.h1, r.n_docs, r.last) for r in store.rows().collect()} == {(1, 5, 4)} | {(10 + k, 1, k) for k in range(5)}


def test_line_dedup_goes_through_the_anti_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pool = [f"line number {i} that is long enough to be counted here" for i in range(30)]
    rows = [(i, "\n".join([pool[j] for j in rng.integers(0, 30, 4)] + [f"own {i}", ""]), "en") for i in range(60)]
    rows += [(None, pool[0], "en"), (None, "\n".join(pool[:3]), "en"), (7, rows[7][1], "en"), (1000, pool[1] + "\nx" * 100_000, "en")]
    plans, unseen = [], lines.LineStore.unseen

    def kept(self, hashes):
        out = unseen(self, hashes)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(lines.LineStore, "unseen", kept)
    ids = {}
    for d, t, _ in rows:
        for x in {x.strip().lower() for x in t.split("\n") if len(x) >= 40}:
            ids.setdefault(x, set()).add(-1 if d is None else d)
    want = sorted((str(d), "\n".join(x for x in t.split("\n") if not (len(s := ids.get(x.strip().lower(), ())) >= 5 and (d is None or d < max(s))))) for d, t, _ in rows)
    for common in (lines.COMMON_ROWS, 0):  # broadcast, and joined by id
        got = lines.drop_repeats(docs(spark, rows), batches=7, common_rows=common).collect()
        assert sorted((str(r.doc_id), r.kept) for r in got) == want and all(r.n_lines - r.n_dropped == len(r.kept.split("\n")) or not r.kept for r in got)
    assert len(plans) >= 12 and all("SortMergeJoin" in p and "LeftAnti" in p for p in plans)


def test_overlapping_and_single_phrases(spark):
    d = docs(spark, [(1, "a a A", "en"), (2, "b", "en"), (3, None, "en")])
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word) for r in licenses.scan(d, phrases={"a a": "twice"}).collect()}
    assert got == {1: (2, 0, 1), 2: (0, None, None), 3: (0, None, None)}


def test_licenses(spark):
    rows = [(1, "x CC BY cc-by\nAll rights\nreserved", "en"), (2, "Released under the MIT License.", "en"), (3, None, None), (4, "nothing here", "en")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (8, 3, 1, 5, "cc-by,reserved")
    assert (got[2].n_base, got[2].labels, got[2].first_word) == (0, "mit", None) and got[2].score >= 0.8
    assert (got[3].n_words, got[3].labels, got[4].score) == (0, "", 0.0)


def test_wrapped_licenses(spark):
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        rows += [(3 * k, "before it\n" * 30 + " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :]) + "\nafter it", "en"), (3 * k + 1, "\n * ".join(w), "en")]
        rows.append((3 * k + 2, ("\n" + "other words " * 30).join(w), "en"))
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        for i in (3 * k, 3 * k + 1):
            assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert got[3 * k + 2].labels == "" and got[3 * k + 2].score == 0.0
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    assert [r.labels for r in licenses.scan(docs(spark, [(1, bsd, "en")])).collect()] == ["bsd"]


def test_language_and_quality_and_mixing(spark):
    rows = [(i, ("the house and the garden of " if i % 2 else "das Haus und der Garten von ") * 5 + str(i), "en" if i % 2 else "de") for i in range(40)] + [(99, None, None), (98, "123 !", None), (97, "the garden and the house " * 9 + "das Haus und der Garten " * 6, None)]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in langid.digest(d).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert got[99].lang_pred == got[98].lang_pred == "und" and got[97].lang_pred == "en" and got[97].score < 1
    labels = spark.createDataFrame([(i, i % 2, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    q = quality.classify(d, labels).collect()
    assert len(q) == len(rows) and all(0 <= r.score <= 1 for r in q)
    r = {x.doc_id: x for x in mixing.rates(d, labels).collect()}
    assert all((r[i].rate < 0.5) == (i % 2 == 0) for i in range(40)) and len(r) == len(rows) and r[0].gap < 0.3


def test_rates_meet_reachable_targets_as_a_dense_solver_does(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([8, 0.3, 0.2], 500)
    n = rng.integers(1, 100, 500).astype(float)

    def totals(steps):
        x = mixing.replayed(p, steps)
        return (x * n) @ p, (p * (n * (x > 0))[:, None]).T @ p

    own = n @ p
    shares = np.array([1.0, 0.25, 0.1])
    steps, gap, converged = mixing.solve(totals, shares * own)
    x = mixing.replayed(p, steps)
    assert converged and gap <= mixing.TOLERANCE and np.abs((x * n) @ p / own - shares).max() <= 1e-3 and x.min() >= 0
    y, a = np.ones(500), (p * n[:, None]) / own  # a dense solver: many plain projected steps on the same squares
    for _ in range(50_000):
        y = np.maximum(0, y - a @ (y @ a - shares) / np.linalg.norm(a, 2) ** 2)
    assert np.abs(y @ a - shares).max() <= 1e-3
    p[:] = 0.7 * p + 0.1  # no text is free of any domain
    missed = mixing.solve(totals, np.array([1.0, 0.0, 0.0]) * own)
    assert not missed[2] and 0 < missed[1] < 1


def test_copies_meet_the_rates(spark):
    rates = [0.0, 0.2, 0.5, 0.8, 1.0, 1.1, 1.4, 2.9]
    d = spark.range(4000).selectExpr("id % 8 as k", "id as key")
    d = d.select("k", mixing.copies(F.element_at(F.array(*map(F.lit, rates)), (F.col("k") + 1).cast("int")), "key").alias("n"))
    got = {r.k: r.m for r in d.groupBy("k").agg(F.avg("n").alias("m")).collect()}
    assert [got[k] for k in (0, 1, 3, 4, 5, 7)] == [0, 0, 1, 1, 1, 3] and abs(got[2] - 0.5) < 0.07 and abs(got[6] - 1.4) < 0.07


def test_simhash_against_brute_force(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base, "en"), (3, base.upper(), "en"), (9, base + " tail", "en"), (1, "quite another text of words", "en"), (7, None, None), (6, "  ", None)]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    w = base.split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(198)]
    fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 198)
    assert got[5].fingerprint == f"{fp:016x}" and got[5].component_id == got[3].component_id == 3
    assert got[7].component_id == got[6].component_id == 6 and got[7].fingerprint == "0" * 16


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None)], "item_id long, text string")
    rows = [(1, "a b " + item.replace(" ", ", ") + " c", "en"), (2, "one two three four five six seven eight nine", "en"), (3, "a SHORT item", "en"), (4, None, None)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.digest(docs(spark, rows), bench).collect()}
    assert got == {1: (14, 11, 1, True), 2: (9, 0, 0, False), 3: (3, 2, 1, True), 4: (0, 0, 0, False)}


def test_empty_tables(spark):
    d = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (lines.digest, licenses.scan, langid.digest, simhash.near_duplicates, lambda x: quality.classify(x, labels), lambda x: mixing.rates(x, labels)):
        assert f(d).count() == 0
    assert neighbours.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
