"""Line deduplication on levelled sorted runs of line hashes.

A store keeps runs: Parquet tables of (h1, h2, n_docs, last), sorted by hash, one
per level and number, no hash in two of them. Each batch of documents is aggregated to one row per line
hash and merge-anti-joined with the runs: what remains is new to the store and becomes a
run of level 0; the rest, known hashes, becomes a tally, which adds to their counts. When a level has FANOUT runs
(or there are FANOUT tallies) they are merged into one, so that each hash is rewritten a logarithmic number of times.
Batches must not share documents; drop_repeats() deals them by a hash of doc_id.

A line's key is hashed to 128 bits. Counts are combined before the shuffle, so a
line found in every document does no harm. Common lines are broadcast while there are at most COMMON_ROWS of them, and texts
are filtered where they are; beyond that, what a document loses comes back to it by its doc_id. Its lines are filtered in one
pass over the whole text.

Edge cases: a null or empty text is one empty line; repeated rows of a doc_id
count as one document and are filtered alike; rows without doc_id count as one
document, which is never the last; a last line without a newline counts like any
other; long texts are handled whole; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import encoded, map_batches, new_dir, pick, written

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 3
BATCHES = 4
#: Common lines that are broadcast (24 bytes each), at most.
COMMON_ROWS = 500_000
BLANK = b" \t\n\v\f\r"
RUN = "h1 long, h2 long, n_docs long, last long"
NO_ID = -(1 << 63)


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128 bits of a line's key, or None if the key is shorter than min_chars code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    a = xxhash.xxh64_intdigest(key, 42)
    b = xxhash.xxh64_intdigest(key, a)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2), once per row of docs and key."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for d, text in zip(b.column(0).to_pylist(), encoded(b.column(1))):
            for h in {line_hash(x, min_chars) for x in text.split(b"\n")} - {None}:
                for col, v in zip(out, (d, *h)):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "h1", "h2"])

    rows = pick(docs, doc_id="doc_id", text="text").where(F.length("text") >= min_chars)
    return map_batches(rows, each, "doc_id long, h1 long, h2 long")


class LineStore:
    """The levelled runs, in one folder of the shared store. levels[k] holds the paths of level k, oldest first; tallies those of
    counts that add to them."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder or new_dir(spark, "line_runs"), fanout
        self.levels: list[list[str]] = []
        self.tallies: list[str] = []
        self.made = 0

    def _write(self, rows: DataFrame, tag: str) -> str:
        path = f"{self.folder}/{tag}/run{self.made}"
        self.made += 1
        # one range per task, each sorted: the run is sorted as a whole
        rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(path)
        return path

    def _run(self, rows: DataFrame, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        path = self._write(rows, f"level{level}")
        self.levels[level].append(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def rows(self) -> DataFrame:
        """All runs with their tallies, as one row per hash."""
        runs = self._read([p for level in self.levels for p in level])
        return self.merged(runs.unionByName(self._read(self.tallies))) if self.tallies else runs

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows of a batch (h1, h2, ...) whose hash is in no run: a merge-anti-join with each run."""
        for level in self.levels:
            for path in level:
                hashes = hashes.join(self._read([path]).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, h1, h2; distinct) and compacts; returns the batch's hashes that are new, as (h1, h2, n_docs, last)."""
        batch = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        if not self.levels:
            fresh = self._read([self._run(batch, 0)])
        else:
            batch = self._read([self._write(batch, "batch")])
            fresh = self._read([self._run(self.unseen(batch), 0)])
            known = batch.join(fresh.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self.tallies.append(self._write(known, "tally"))
        if len(self.tallies) >= self.fanout:
            self.tallies = [self._write(self.merged(self._read(self.tallies)), "tally")]
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                group, self.levels[k] = self.levels[k], []
                self._run(self._read(group), k + 1)
            k += 1
        return fresh


def _batch(ids: pa.Array, texts: list[bytes], lost) -> pa.RecordBatch:
    """lost: gets the lines of all texts (owner, h1, h2 of those long enough) and says which go."""
    owner, place, a, b = [], [], [], []
    split = [t.split(b"\n") for t in texts]
    for k, own in enumerate(split):
        for i, line in enumerate(own):
            if h := line_hash(line, lost.min_chars):
                owner.append(k)
                place.append(i)
                a.append(h[0])
                b.append(h[1])
    gone: dict[int, set[int]] = {}
    if owner:
        for j in np.flatnonzero(lost(np.array(owner), np.array(a), np.array(b))).tolist():
            gone.setdefault(owner[j], set()).add(place[j])
    kept = [b"\n".join(x for i, x in enumerate(own) if i not in gone[k]) if k in gone else texts[k] for k, own in enumerate(split)]
    n = [pa.array([f(k) for k in range(len(texts))], pa.int64()) for f in (lambda k: len(split[k]), lambda k: len(gone.get(k, ())))]
    return pa.RecordBatch.from_arrays([ids, *n, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


KEPT = "doc_id long, n_lines long, n_dropped long, kept string"


class _Common:
    """Which lines go, by a table of common lines that is sorted by h1."""

    def __init__(self, table, ids: pa.Array, min_chars: int):
        self.table, self.ids, self.min_chars = table, ids, min_chars

    def __call__(self, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h1, h2, last = self.table
        if not len(h1):
            return np.zeros(len(a), bool)
        at = np.minimum(np.searchsorted(h1, a), len(h1) - 1)
        null = self.ids.is_null().to_numpy(zero_copy_only=False)[owner]
        own = self.ids.fill_null(0).to_numpy()[owner]
        return (h1[at] == a) & (h2[at] == b) & (null | (own < last[at]))


class _Listed:
    """Which lines go, by each document's own list."""

    def __init__(self, lists: list, min_chars: int):
        self.sets, self.min_chars = [set(zip(*x)) if x[0] else () for x in lists], min_chars

    def __call__(self, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([(x, y) in self.sets[k] for k, x, y in zip(owner.tolist(), a.tolist(), b.tolist())])


def drop_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, common_rows: int = COMMON_ROWS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row of docs."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id="doc_id", text="text")
    found = written(line_hashes(rows, min_chars).distinct().withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "line_hashes", ["batch"])
    store = LineStore(spark)
    for k in range(batches):
        store.add(found.where(F.col("batch") == k).select("doc_id", "h1", "h2"))
    common = written(store.rows().where((F.col("n_docs") >= min_docs) & F.col("last").isNotNull()).select("h1", "h2", "last"), "common_lines")
    if common.count() <= common_rows and not common.groupBy("h1").count().where("count > 1").limit(1).count():
        t = common.toPandas().sort_values("h1")  # at most common_rows rows
        shared = spark.sparkContext.broadcast(tuple(t[c].to_numpy(np.int64) for c in ("h1", "h2", "last")))
        return map_batches(rows, lambda b: _batch(b.column(0), encoded(b.column(1)), _Common(shared.value, b.column(0), min_chars)), KEPT)
    gone = found.join(common, ["h1", "h2"]).where("doc_id is null or doc_id < last")
    gone = gone.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    both = rows.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).join(gone, "_id", "left").select("doc_id", "text", F.col("gone.h1").alias("g1"), F.col("gone.h2").alias("g2"))
    return map_batches(both, lambda b: _batch(b.column(0), encoded(b.column(1)), _Listed(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist())), min_chars)), KEPT)


def digest(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in SQL, for doc_ids that are unique and not null.
SQL = r"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.last as gone from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
