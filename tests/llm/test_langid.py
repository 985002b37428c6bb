import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_viterbi_against_all_paths(block):
    rng = np.random.default_rng(2)
    size = [6, 0, 1, 5]
    first = np.concatenate(([0], np.cumsum(size)))
    s = rng.integers(-3000, 1, (12, 3))
    got = langid.viterbi(s, first, 1000, block)
    for a, z in itertools.pairwise(first):
        value = lambda p, a=a: sum(int(s[a + i, k]) for i, k in enumerate(p)) - 1000 * sum(x != y for x, y in itertools.pairwise(p))
        assert value(got[a:z].tolist()) == max(map(value, itertools.product(range(3), repeat=int(z - a))))


def test_word_scores_against_counting():
    texts = {"a": ["abra kadabra", "bar"], "b": ["xyz zyx abx"]}
    m = langid.train(texts)
    grams = lambda w: [f" {w} "[i : i + n] for n in langid.GRAMS for i in range(len(w) + 3 - n)]
    counts = [Counter(g for t in texts[x] for w in t.split() for g in grams(w)) for x in "ab"]
    seen = len(set(counts[0]) | set(counts[1]))
    p = lambda g, c: math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * seen))
    for word in ("abra", "zyx", "q", "xyzabra"):
        s = np.array([sum(round(langid.UNIT * p(g, c)) for g in grams(word)) // 2 for c in counts])
        want = np.maximum(s - s.max(), langid.WORST)
        got, n = langid.word_scores([word.encode()], m)
        assert got[0].tolist() == want.tolist() and n[0] == len(word)


def test_scripts_narrow_and_spans(spark):
    rows = [(i, "мир и дом и сад " * 4 if i % 2 else "the house and garden ", "ru" if i % 2 else "en") for i in range(20)]
    rows += [(100, "the house and the garden мир и дом и сад the garden", None), (101, "12 34 !", None), (102, None, "en"), (103, "", "en"), (104, "²³", None), (None, "the house", "en"), (3, rows[3][1], "ru")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, TEXT_ string, extra int")
    got = langid.identify(d, langid.fit(d), spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [x["lang"] for x in by[100].spans] == ["en", "ru", "en"] and by[100].lang_pred == "en"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (101, 102, 103, 104)) and by[None].lang_pred == "en"


def test_case_clashing_columns_and_no_language(spark):
    d = spark.createDataFrame([(1, "a text", None, 5, "z")], "doc_id long, text string, lang string, DOC_ID int, TEXT string")
    assert [(r.lang_pred, r.score, r.held_out) for r in langid.digest(d).collect()] == [("und", 0.0, False)]


def test_every_language_is_learned(spark):
    letters = [chr(a) + chr(b) for a in range(97, 123) for b in range(97, 123)][:300]
    d = spark.createDataFrame([(i, f"{x * 3} {x * 2} {x}{x[::-1]}{x}", f"lang{x}") for i, x in enumerate(letters)], "doc_id long, text string, lang string")
    assert len(langid.fit(d).langs) == 300


def test_long_text_is_labelled_whole():
    m = langid.train({"en": ["the house and the garden"], "de": ["das Haus und der Garten"]})
    text = b"the house and the garden " * 60_000 + b"das Haus und der Garten " * 61_000
    s, n, first = langid._scored([text, b""], m)
    label = langid.viterbi(s, first, m.penalty)
    assert first.tolist() == [0, 605_000, 605_000]
    assert [m.langs[k] for k in label[[0, 299_999, 300_000, -1]]] == ["en", "en", "de", "de"] and (np.diff(label) != 0).sum() == 1


def test_held_out_accuracy(spark):
    got = {r.doc_id: r.lang_pred for r in langid.digest(spark.read.parquet(SF)).where("held_out").collect()}
    t = pq.read_table(SF).to_pydict()
    known = [(d, x) for d, x, text in zip(t["doc_id"], t["lang"], t["text"]) if x and text and zlib.crc32(str(d).encode()) % 4 == 2 and any(map(str.isalpha, text))]
    assert len(known) > 100 and np.mean([got[d] == x for d, x in known]) >= 0.99
