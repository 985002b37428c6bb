"""Files of the shared store through Spark's own file systems: small documents, atomic replacement, versions, checksums, and a folder to write to."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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
    return f"{shared_dir(spark)}/market/{tag}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, path: str):
    """(file system, path), both of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = files_of(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document, complete or not at all: written beside its place and then moved there."""
    fs, p = files_of(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"can't move to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).first().content).decode()


def replace_folder(spark: SparkSession, made: str, path: str) -> None:
    """Moves a folder to a place, whose former one goes."""
    fs, a = files_of(spark, made)
    _, b = files_of(spark, path)
    fs.mkdirs(b.getParent())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"can't move {made} to {path}")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_checksum(spark: SparkSession, path: str) -> str:
    """One for all files, by name; a row a file reaches the driver."""
    rows = checksums(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256").where("name not like '\\\\_%' and name not like '.%'").collect()
    return hashlib.sha256("\n".join(f"{r.name} {r.sha256}" for r in sorted(rows)).encode()).hexdigest()


def row_checksum(*columns: str) -> Column:
    """SHA-256 of a row's JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


class Artifacts:
    """Documents by experiment and version (1.2.3) in a folder, with when and by whom they were brought out."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, experiment: str, version: str, document: dict) -> str:
        text = json.dumps(document, sort_keys=True)
        write_text(self.spark, f"{self.folder}/{experiment}/{version}.json", text)
        return hashlib.sha256(text.encode()).hexdigest()

    def versions(self, experiment: str, pattern: str = r"\d+(\.\d+)*") -> list[str]:
        fs, p = files_of(self.spark, f"{self.folder}/{experiment}")
        names = [x.getPath().getName().removesuffix(".json") for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: [int(x) for x in n.split(".")])

    def get(self, experiment: str, version: str = "latest") -> dict:
        if version == "latest":
            found = self.versions(experiment)
            if not found:
                raise KeyError(experiment)
            version = found[-1]
        return json.loads(read_text(self.spark, f"{self.folder}/{experiment}/{version}.json"))

    def experiments(self, **wanted) -> list[dict]:
        """The latest document of each experiment whose fields are as wanted; tags must all be there."""
        fs, p = files_of(self.spark, self.folder)
        out = []
        for x in fs.listStatus(p) if fs.exists(p) else ():
            name = x.getPath().getName()
            d = self.get(name)
            if all(set(v) <= set(d.get(k, ())) if k == "tags" else d.get(k) == v for k, v in wanted.items()):
                out.append({"experiment": name, **d})
        return sorted(out, key=lambda d: d["experiment"])

    def compared(self, names: list[str]) -> dict[str, dict]:
        """Metrics side by side: metric -> experiment -> value."""
        docs = {n: self.get(n).get("metrics", {}) for n in names}
        return {m: {n: d.get(m) for n, d in docs.items()} for m in sorted(set().union(*docs.values()))}
