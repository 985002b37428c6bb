"""WARC archives: writing with revisit records, and reading by verified chains.

Writing: pages are dealt by page_id; each task writes one file under its
attempt's name; only names in the written manifest count. Of equal payloads of
at least MIN_REVISIT bytes the smallest page_id is a response and the others
are revisits without a block.

Reading: files are cut in splits at any byte. A task finds every place of its
split where the magic stands and a header parses, and follows each candidate's
length from record to record until it leaves the split. These candidate-to-exit
pointers form the table on which pointer jumping runs from each file's start,
doubling the step each round; only candidates that are reached hold records,
so a magic inside a payload is rejected whatever it looks like. Rounds grow with
the logarithm of a file's splits.

Edge cases: null html is empty; a null page_id is written and read as null and is
never referred to; repeated rows are records each; equal page_id and payload are
both response; long payloads may span many splits; an empty table gives no file;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, encoded, fs_of, limit_batches, map_batches, new_dir, pick, written

MAGIC = b"WARC/1.1\r\n"
#: What a record may start with; the search is for what they share.
MAGICS, SHARED = (b"WARC/1.0\r\n", MAGIC), b"WARC/1."
MIN_REVISIT = 100
SPLIT = 4 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    own = "null-" + uuid.uuid4().hex if page_id is None else str(page_id)
    uri = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{x:02X}" for x in c.encode()) for c in (url or "urn:x-none"))
    block = HTTP + payload if refers_to is None else HTTP
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{own}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int, most_head: int) -> tuple[dict[str, str], int, int] | None:
    """(fields, start of the block, end of the record) of the record at this place, or None if no header of at most most_head bytes stands there."""
    if not data.startswith(MAGICS, at):
        return None
    stop = data.find(b"\r\n\r\n", at, at + most_head)
    if stop < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : stop].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.decode("latin-1").strip().lower()] = v.decode("latin-1").strip()
    n = fields.get("content-length", "")
    if not (n.isascii() and n.isdigit()) or len(n) > 15:
        return None
    return fields, stop + 4, stop + 8 + int(n)


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP head of a block that has one, else the whole block."""
    if block.startswith(b"HTTP/") and fields.get("content-type", "").startswith("application/http"):
        head, sep, body = block.partition(b"\r\n\r\n")
        return body if sep else b""
    return block


def manifest_of(spark: SparkSession, path: str, most_head: int = 1 << 16) -> DataFrame:
    """A manifest of uncompressed archives of others, whose headers are at most most_head bytes long."""
    found = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"), F.lit(most_head).cast("long").alias("most_head"))
    return written(found.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), "manifest")


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives; returns the manifest (path, n_bytes, most_head); no header of the file is longer than most_head."""
    spark = pages.sparkSession
    limit_batches(spark)
    folder = folder or new_dir(spark, "warc")
    rows = pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    sig = written(rows.where((F.octet_length("html") >= MIN_REVISIT)).select("page_id", "digest"), "digests")
    first = sig.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    later = sig.join(first.hint("merge"), "digest").where("page_id is null or page_id > first").select("page_id", F.col("digest").alias("d"), "first").distinct()
    later = written(later.withColumnRenamed("page_id", "p"), "revisits")
    # pages stay where they are while revisits are few; beyond that nulls and hot ids are spread by the digest
    later = F.broadcast(later) if later.count() <= BROADCAST_ROWS else later.hint("merge")
    typed = rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.octet_length("html") >= MIN_REVISIT), "left")
    typed = typed.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "first")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, most, path = None, 0, 0, ""
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store, base = fs_of(folder)
                store.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.warc"
                path = f"{folder}/{name}"
                out = store.open_output_stream(f"{base}/{name}")
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                data = record(*row)
                out.write(data)
                n += len(data)
                most = max(most, data.index(b"\r\n\r\n") + 4)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": pa.array([n]), "most_head": pa.array([most])})

    return written(typed.mapInArrow(each, "path string, n_bytes long, most_head long"), "manifest")


def _splits(spark: SparkSession, manifest: DataFrame, split: int) -> DataFrame:
    s = manifest.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("begin"), "most_head")
    return s.repartition(spark.sparkContext.defaultParallelism * 2)


def _bytes(path: str, begin: int, end: int, more: int) -> tuple:
    store, p = fs_of(path)
    f = store.open_input_file(p)
    f.seek(begin)
    return f, f.read(end - begin + more)


def candidates(splits: DataFrame, split: int) -> DataFrame:
    """(path, begin, at, exit): each place of a split where a header stands, and where its chain leaves the split
    (-1 where it ends at bytes that aren't a header)."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for path, size, begin, most in zip(*(b.column(i).to_pylist() for i in range(4))):
            end = min(begin + split, size)
            f, data = _bytes(path, begin, end, most)
            f.close()
            nxt, at = {}, data.find(SHARED)
            while 0 <= at < end - begin:
                if (got := parse(data, at, most)) and begin + got[2] <= size:
                    nxt[at] = got[2]
                at = data.find(SHARED, at + 1)
            leave: dict[int, int] = {}
            for at in sorted(nxt, reverse=True):
                to = nxt[at]
                leave[at] = begin + to if to >= end - begin else leave.get(to, -1)
            for at, to in leave.items():
                for col, v in zip(out, (path, begin, begin + at, to)):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], names=["path", "begin", "at", "exit"])

    return map_batches(splits, each, "path string, begin long, at long, exit long")


def entries(spark: SparkSession, manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, begin, at): for each split, the first true record that starts in it."""
    jump = written(candidates(_splits(spark, manifest, split), split), "candidates")
    places = jump.select("path", "begin", "at")
    most = manifest.agg(F.max("n_bytes")).first()[0] or 1
    reached = jump.where("at = 0").select("path", "at")
    step = jump.select("path", "at", "exit")
    for _ in range(max(1, math.ceil(math.log2(max(2, -(-most // split))))) + 1):
        go = reached.join(step.hint("merge"), ["path", "at"]).where("exit >= 0").select("path", F.col("exit").alias("at"))
        reached = written(reached.unionByName(go).distinct(), "reached")
        on = step.select("path", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
        step = written(step.join(on.hint("merge"), ["path", "exit"]).select("path", "at", F.col("beyond").alias("exit")), "jumps")
    return places.join(reached.hint("merge"), ["path", "at"])


def read(spark: SparkSession, manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, path, at) of every true response, resource and revisit; records of
    other kinds are passed over. page_id and refers_to are null in archives of others, and so is what their headers don't tell of a revisit."""
    found = entries(spark, manifest, split).join(manifest.hint("merge"), "path").select("path", "begin", "at", "n_bytes", "most_head").repartition(spark.sparkContext.defaultParallelism * 2)

    def page(urn: str | None) -> int | None:
        tail = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(tail) if tail.lstrip("-").isdigit() else None

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, begin, at, size, most in zip(*(b.column(i).to_pylist() for i in range(5))):
            f, data = _bytes(path, at, begin + split, most)
            with f:
                i = 0
                while at + i < min(begin + split, size):
                    if len(data) - i < most:  # the next header may be cut
                        f.seek(at + i)
                        data, at, i = f.read(begin + split - at - i + most), at + i, 0
                    if (got := parse(data, i, most)) is None:
                        raise ValueError(f"{path}: no record at {at + i}")
                    fields, start, end = got
                    if end > len(data):  # the block goes on beyond what was read
                        f.seek(at + i)
                        data, start, end, at, i = f.read(end - i + most), start - i, end - i, at + i, 0
                    kind, digest, n = fields.get("warc-type"), fields.get("warc-payload-digest"), fields.get("x-payload-length")
                    if kind in ("response", "resource"):
                        payload = payload_of(fields, data[start : end - 4])
                        n, own = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest and digest.startswith("sha256:") and digest != f"sha256:{own}":
                            raise ValueError(f"{path}: wrong digest at {at + i}")
                        digest = own
                    if kind in ("response", "resource", "revisit"):
                        rows.append((page(fields.get("warc-record-id")), None if n is None else int(n), digest and digest.removeprefix("sha256:"), kind, page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), path, at + i))
                    i = end
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "at"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return map_batches(found, each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, at long")


def digest(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return read(spark, write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
