"""Token ids in length-delimited binary records with a separate offset index.

A record file is a run of frames: length (unsigned 64-bit little-endian), masked
CRC of these 8 bytes, payload, masked CRC of the payload. A payload is the
doc_id (64-bit; NO_ID for null), the width of an id in bytes (2 where the
vocabulary fits, else 4) and the ids, unsigned little-endian. The mask rotates
the CRC-32 and adds a constant, so that a checksum of data that hold checksums
stays sound. An index file beside it holds one ENTRY per record - doc_id, offset,
number of ids - so that a reader can take records in any order.

Rows are dealt by ranges of doc_id; each task tokenizes and writes one file under
a name of its own attempt, and only names in the written manifest count, so a
repeated task does no harm. Only the manifest (a row per file) reaches the driver.

Words are looked up in a bounded cache of ids: most of a tokenizer's time goes into words it has met before. Texts whose
characters are plain (no mark, no rare letter, no added token) are normalised and split here just as the tokenizer does it; all
others, and all texts under a tokenizer with other rules, go to the tokenizer whole.

Edge cases: a null text is empty and gives the end id alone; a null doc_id comes
first; repeated rows of a doc_id are written each, in the order of their text;
long texts are encoded whole; an empty table gives no file; extra columns are
ignored.
"""

from __future__ import annotations

import json
import os
import random
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fs_of, limit_batches, map_batches, new_dir, pick, written

END_ID = 2
NO_ID = -(1 << 63)
ENTRY = "<qQQ"
MASK = 0xA282EAD8
#: Texts encoded at once.
CHUNK = 64
#: Distinct words whose ids a worker keeps, and the longest of them.
CACHE, LONGEST = 300_000, 48

#: The rules under which a text can be split here - normalizers and pre-tokenizers, as the file states them.
NORMALIZER = ["NFC", ("Replace", r"\s+", " "), "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with anything but these characters, or the start of an added token, aren't split here.
ODD = re.compile("[^\t\n\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]|<\\|")


def _plain(kind: str) -> str:
    """The plain characters of a general category, for a character class."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


WORD = re.compile(SPLIT.replace(r"\p{L}", _plain("L")).replace(r"\p{N}", _plain("N")))


class Encoder(dict):
    """Ids of texts; as a dict, of words, as the bytes of their array."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        rules = json.loads(self.tok.to_str())
        norm = [x["type"] if x["type"] != "Replace" else ("Replace", x["pattern"].get("Regex"), x["content"]) for x in (rules.get("normalizer") or {}).get("normalizers", ())]
        pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers", ())
        split = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre]
        self.own = norm == NORMALIZER and split == [("Split", SPLIT, True, None, None), ("ByteLevel", None, None, False, False)] and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # a byte is written as itself or, if it can't be seen, as one of the characters from 256 on
        self.shown = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per process: workers serve many tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.tok.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.shown))]).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, texts: list[str]) -> list[array]:
        out = [None if not self.own or ODD.search(t) else array("I", b"".join(map(self.__getitem__, WORD.findall(t.lower())))) for t in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        for i in range(0, len(rest), CHUNK):
            part = rest[i : i + CHUNK]
            for k, e in zip(part, self.tok.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)):
                out[k] = array("I", e.ids)
        return out


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(f, at: int) -> bytes:
    """The payload of the frame at this offset of an open file; ValueError if a checksum is wrong."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"bad length at {at}")
    n = struct.unpack("<Q", head[:8])[0]
    data = f.read(n + 4)
    if len(data) < n + 4 or masked(data[:n]) != struct.unpack("<I", data[n:])[0]:
        raise ValueError(f"bad payload at {at}")
    return data[:n]


def ids_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[8]}", offset=9).astype("<u4")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes record and index files; returns the manifest (part, path, n_records, n_tokens), part in doc_id order."""
    spark = docs.sparkSession
    limit_batches(spark)
    folder = folder or new_dir(spark, "records")
    rows = pick(docs, doc_id="doc_id", text="text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text").withColumn("part", F.spark_partition_id())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = out = index = None
        n = total = at = part = width = 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                enc = Encoder.of(tokenizer)
                width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                part = b.column(2)[0].as_py()
                store, base = fs_of(folder)
                store.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                out, index = (store.open_output_stream(f"{base}/{name}.{x}") for x in ("rec", "idx"))
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(texts), CHUNK):
                for d, own in zip(ids[i : i + CHUNK], enc.ids([t or "" for t in texts[i : i + CHUNK]])):
                    d = NO_ID if d is None else d
                    seq = np.append(np.frombuffer(own, np.uint32), np.uint32(end_id)).astype(f"<u{width}")
                    data = frame(struct.pack("<qB", d, width) + seq.tobytes())
                    out.write(data)
                    index.write(struct.pack(ENTRY, d, at, len(seq)))
                    at += len(data)
                    n += 1
                    total += len(seq)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_records": pa.array([n]), "n_tokens": pa.array([total])})

    return written(rows.mapInArrow(each, "part int, path string, n_records long, n_tokens long"), "manifest")


def read_index(path: str) -> list[tuple[int, int, int]]:
    store, p = fs_of(path + ".idx")
    with store.open_input_stream(p) as f:
        return list(struct.iter_unpack(ENTRY, f.read()))


def shuffled(path: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of one file's records in a seeded random order, by way of its index."""
    entries = read_index(path)
    random.Random(seed).shuffle(entries)
    store, p = fs_of(path + ".rec")
    with store.open_input_file(p) as f:
        for d, at, _ in entries:
            yield None if d == NO_ID else d, ids_of(unframe(f, at))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, checked against its checksums; start counts the ids before it."""
    files = sorted(manifest.collect(), key=lambda r: r.part)  # a row per file
    rows, at = [], 0
    for r in files:
        rows.append((r.path, at))
        at += r.n_tokens
    todo = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            store, p = fs_of(path + ".rec")
            with store.open_input_file(p) as f:
                for d, at, n in read_index(path):
                    ids = ids_of(unframe(f, at)).tobytes()
                    if len(ids) != 4 * n:
                        raise ValueError(f"{path}: index and record differ at {at}")
                    for col, v in zip(out, (None if d == NO_ID else d, start, n, zlib.crc32(ids))):
                        col.append(v)
                    start += n
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(todo, each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read(docs.sparkSession, write(docs, tokenizer or tokenizer_path()))
