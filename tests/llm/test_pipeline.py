"""The pipeline's stages, and run(), against plain versions of what each decides."""

import importlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.01"
pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that leave each stage over sf0.01."""
    from tidemark.llm.common import written

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, f in pipeline.STAGES:
        docs = written(f(spark, docs, SF), "test_stage")
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_whole_rows(stages):
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and all(texts[r.doc_id] == r.text for r in df.collect())


def test_quality_keeps_what_scores_enough(spark, stages):
    from tidemark.llm import quality

    want = {r.doc_id for r in quality.classify(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.score >= 0.3}
    assert ids(stages[1]) == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d in want for d, q in labels.items() if q == 1 and d in ids(stages[0])]
    bad = [d in want for d, q in labels.items() if q == 0 and d in ids(stages[0])]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.3


def test_near_duplicates_keep_one_of_each_group(stages):
    from tidemark.llm import simhash

    rows = stages[1].select("doc_id", "text").collect()
    fp = simhash.fingerprints_of([(r.text or "").encode() for r in rows])
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= simhash.RADIUS
    label = np.array([r.doc_id for r in rows])
    while True:  # the smallest doc_id reachable, by plain repetition
        new = np.array([label[x].min() for x in near])
        if (new == label).all():
            break
        label = new
    assert ids(stages[2]) == {int(r.doc_id) for r, x in zip(rows, label) if r.doc_id == x}


def test_benchmark_passages_go(stages):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [words(t) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    dirty = {r.doc_id for r in stages[2].collect() if any(tuple(w[i : i + n]) in windows for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))}
    assert dirty and ids(stages[3]) == ids(stages[2]) - dirty


def test_mixing_thins_toxic_text_and_keeps_clean(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ids(stages[3]), ids(stages[4])
    clean = [d in after for d in before if d in labels and labels[d].toxic == 0 and labels[d].quality == 1]
    toxic = [d in after for d in before if d in labels and labels[d].toxic == 1]
    assert len(clean) > 100 and np.mean(clean) > 0.98 and np.mean(toxic) < 0.5
    seen = [d in after for d in before]
    assert np.mean(seen) > 0.8


def test_run_gives_the_last_stage(spark, stages):
    got, want = (sorted(map(tuple, df.collect())) for df in (pipeline.run(spark, SF), stages[-1]))
    assert got == want and len(got) == stages[4].count()


def test_clashing_names_empty_and_null_rows(spark, tmp_path):
    names = ["doc_id", "text", "lang", "DOC_ID", "Text", "_id", "_key", "score", "gone_id", "_0"]
    text = "some words that are here and there and everywhere in the house and garden "
    rows = [[i, None if i == 3 else "" if i == 4 else text + f"number {i} " * 5, "en", 5, "x", 1, 2, 0.0, 7, 9] for i in [0, 1, 2, 3, 4, 5, 5, None]]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    schema = "long, string, string, long, string, long, long, double, long, long".split(", ")
    pq.write_table(pa.table({"doc_id": pa.array([0, 1, 2], pa.int64()), "quality": pa.array([1, 0, 1], pa.int32()), "toxic": pa.array([0, 1, None], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, None]), "text": pa.array(["quite another text of ten words that is not there", None])}), tmp_path / "benchmark.parquet")
    assert len(kinds) == len(names)
    for some in (rows, []):
        docs = spark.createDataFrame(some, ", ".join(f"c{i} {t}" for i, t in enumerate(schema))).toDF(*names)
        for _, f in pipeline.STAGES[:-1]:
            out = f(spark, docs, str(tmp_path))
            assert out.columns == names and out.count() <= 2 * max(1, len(some))
        assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(some)
