"""What the operators of this subpackage share: the shared folder, written
tables, bounded Arrow batches and vectorised word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW_BYTES = 1 << 20

#: Bytes of lower-cased words: digits, a-z and every byte of a non-ASCII character; all else becomes a space.
WORD_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def limit_batches(spark: SparkSession, nbytes: int = ARROW_BYTES) -> None:
    """Bound Arrow batches by bytes, so that long texts and packed blocks don't fill a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(nbytes))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Sessions on one machine without one get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    path = new_dir(df.sparkSession, tag)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fs_of(uri: str):
    """(pyarrow filesystem, path) of a folder or file of the shared store; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def place_of(df: DataFrame, column: str) -> int:
    """The position of a column: of the exact name, else of the first that differs in case alone."""
    names = df.columns
    return names.index(column) if column in names else [c.lower() for c in names].index(column.lower())


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1, ..., so that clashing names do no harm; toDF(*df.columns) gives them back."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (new name=column of df); clashing extra columns do no harm."""
    return numbered(df).select(*[F.col(f"_{place_of(df, c)}").alias(n) for n, c in columns.items()])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with docs' columns, whose doc_id and hash of the text aren't in gone(gone_id, gone_key)."""
    inner = numbered(docs)
    d, t = (F.col(f"_{place_of(docs, c)}") for c in ("doc_id", "text"))
    kept = inner.join(gone.select("gone_id", "gone_key").distinct(), d.eqNullSafe(F.col("gone_id")) & F.xxhash64(t).eqNullSafe(F.col("gone_key")), "left_anti")
    return kept.toDF(*docs.columns)


#: Tables of up to so many narrow rows (of some tens of bytes) are broadcast.
BROADCAST_ROWS = 200_000


def dealt(rows: DataFrame, keys: list[str], size: int, by: str) -> DataFrame:
    """rows with block: groups of the same keys are cut in blocks of about size rows by a hash of a column. What is grouped
    by keys and block afterwards is dealt out by both, so that a hot key is many tasks' work."""
    hot = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("long").alias("blocks")).where("blocks > 1")
    hot = written(hot, "hot")
    few = hot.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(hot) if few else hot, keys, "left").withColumn("block", F.pmod(F.xxhash64(by), F.coalesce("blocks", F.lit(1).cast("long")))).drop("blocks")
    return out if few else out.repartition(*keys, "block")


def map_batches(df: DataFrame, f, schema: str | T.StructType) -> DataFrame:
    """mapInArrow under the byte limit; f takes a RecordBatch and returns one or None."""
    limit_batches(df.sparkSession)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(each, schema)


def crc_of_id(column: str):
    """crc32 of the id as text, the rule that deals documents to folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


class Words:
    """The words of many texts at once. data: all bytes after the table, a space between texts; start, end: of each word;
    doc: its text; first: index of each text's first word (one more at the end); hash: 64 bits of its bytes."""

    _powers: np.ndarray | None = None
    _inverse: np.ndarray | None = None
    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, texts: list[bytes], table: bytes = WORD_TABLE):
        self.data = b" ".join(t.translate(table) for t in texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        solid = (raw != 32).view(np.int8)
        edge = np.flatnonzero(np.diff(solid, prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.raw = raw

    def hashes(self) -> np.ndarray:
        n = len(self.raw) + 1
        if Words._powers is None or len(Words._powers) < n:
            size = 1 << max(20, n.bit_length())
            inv = pow(self.BASE, -1, 1 << 64)
            p = np.full(size, self.BASE, np.uint64)
            q = np.full(size, inv, np.uint64)
            p[0] = q[0] = 1
            Words._powers, Words._inverse = np.cumprod(p), np.cumprod(q)
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * Words._powers[: n - 1])))
        return mix((s[self.end] - s[self.start]) * Words._inverse[self.start])

    def text(self, i: int, j: int) -> bytes:
        """Words i to j of one text, joined by a space."""
        return b" ".join(self.data[self.start[i] : self.end[j - 1]].split()) if j > i else b""


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one long sequence (len - k + 1 of them, across texts too)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hash[i : i + n])
    return h
