import hashlib
import zlib

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import records, warc

TEXTS = [(3, "Hello, world again"), (1, None), (2, ""), (None, "no id"), (5, "the quick fox " * 400), (3, "another of three"), (7, "naïve café <|endoftext|>")]


def test_round_trip_of_records(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, Start int").repartition(3)
    path = records.tokenizer_path()
    tok = Tokenizer.from_file(path)
    manifest = records.write(docs, path)
    got = [tuple(r) for r in records.read(spark, manifest).orderBy("start").collect()]
    want, at = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    some = manifest.first().path
    assert sorted(len(x[1]) for x in records.shuffled(some, 1)) == sorted(e[2] for e in records.read_index(some))


def test_no_records(spark):
    assert records.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_damage_is_seen(tmp_path):
    data = bytearray(records.frame(b"abcdef"))
    data[14] ^= 1
    (tmp_path / "x").write_bytes(bytes(data))
    with open(tmp_path / "x", "rb") as f:
        try:
            records.unframe(f, 0)
        except ValueError:
            return
    raise AssertionError


def pages():
    trap = warc.record(9, "http://x", b"inner" * 30, "0" * 64, None).decode()
    long = "é" * 300
    return [(1, "u", long), (2, "u v\r\n", long), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", trap * 3), (7, "u", trap * 3), (8, "u", "z" * 5000), (None, "u", long), (2, "u", long), (10, "u", warc.MAGIC.decode() * 50)]


def test_warc_chain(spark):
    df = spark.createDataFrame([(*p, "x") for p in pages()], "page_id long, url string, html string, digest string").repartition(2)
    manifest = warc.write(df)
    want = []
    for i, _, h in pages():
        b = (h or "").encode()
        same = [j for j, _, g in pages() if (g or "") == (h or "") and j is not None]
        rev = len(b) >= 100 and (i is None or i > min(same))
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if rev else "response", min(same) if rev else None))
    for split in (64, 700, 1 << 20):
        got = [tuple(r)[:5] for r in warc.read(spark, manifest, split).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_keeps_long_urls(spark):
    urls = ["data:," + "a" * 100_000 + x for x in "bc"] + ["http://x/é" + "é" * 3000, "http://short"]
    want = [u.replace("é", "%C3%A9") for u in urls]
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(2)
    manifest = warc.write(df)
    for split in (5000, 1 << 20):
        assert [r.url for r in warc.read(spark, manifest, split).orderBy("page_id").collect()] == want


def test_archive_of_others(spark, tmp_path):
    def rec(version, kind, block, **more):
        head = "".join(f"{k.replace('_', '-')}:{v}\r\n" for k, v in {"WARC_Type": kind, "WARC_Target_URI": "http://a/b", **more, "Content_Length": len(block)}.items())
        return f"WARC/{version}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"

    body = b"<p>WARC/1.0\r\nContent-Length: 3\r\n\r\nabc</p>"
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * 300 + b"\r\n\r\n" + body
    data = rec("1.0", "warcinfo", b"software: x") + rec("1.0", "request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request")
    data += rec("1.0", "response", http, Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:ABC", WARC_Record_ID="<urn:uuid:1-2>")
    data += rec("1.1", "resource", body, Content_Type="text/html") + rec("1.1", "revisit", b"", WARC_Payload_Digest="sha1:ABC")
    (tmp_path / "a.warc").write_bytes(data)
    want = hashlib.sha256(body).hexdigest()
    for split in (50, 1 << 20):
        got = sorted((r.at, r.record_type, r.payload_bytes, r.payload_digest, r.page_id, r.url) for r in warc.read(spark, warc.manifest_of(spark, f"file://{tmp_path}/a.warc"), split).collect())
        assert [x[1:] for x in got] == [("response", len(body), want, None, "http://a/b"), ("resource", len(body), want, None, "http://a/b"), ("revisit", None, "sha1:ABC", None, "http://a/b")]


def test_no_pages(spark):
    assert warc.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
