"""Snapshots on disk: Parquet parts with a manifest of counts and checksums, and a cache by content.

Parts are written first and the manifest last, so a folder with a manifest is whole. validate()
reads every part anew and compares. Checksums are order-free sums of row hashes worked out by
Spark, so they hold however the parts are split into files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .reader import Snapshot

VERSION = 2


class WireError(ValueError):
    """A stored snapshot that is not what its manifest says."""


def _summary(parsed: DataFrame) -> dict:
    """Documents, axioms and a checksum of the parsed rows; the same whatever the partitions."""
    text = F.to_json(F.struct(*(F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in parsed.dtypes)))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    r = parsed.agg(*(F.count_if(F.col("part") == p).alias(f"{p}s") for p in ("document", "root", "node")), F.sum("byte_length").alias("bytes"), F.sum(h).alias("sum")).first()
    return {"documents": r["documents"], "roots": r["roots"], "nodes": r["nodes"], "bytes": int(r["bytes"] or 0), "checksum": str(r["sum"] or 0)}


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def encode(snapshot: Snapshot, path: str) -> dict:
    """Writes a snapshot to a new folder and gives its manifest."""
    spark = snapshot.parsed.sparkSession
    snapshot.parsed.write.parquet(f"{path}/parsed")
    manifest = {"version": VERSION, "schema": snapshot.parsed.schema.jsonValue(), **_summary(spark.read.parquet(f"{path}/parsed"))}
    p, fs = _file(spark, f"{path}/manifest.json")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return manifest


def manifest(spark: SparkSession, path: str) -> dict:
    p, fs = _file(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        raise WireError(f"{path} has no manifest: it was not written to its end")
    rows = spark.read.text(f"{path}/manifest.json", wholetext=True).collect()
    return json.loads(rows[0][0])


def open_snapshot(spark: SparkSession, path: str, check: bool = False) -> Snapshot:
    """A stored snapshot, lazily; with check, after validate()."""
    told = manifest(spark, path)
    if told.get("version") != VERSION:
        raise WireError(f"version {told.get('version')} is not read, {VERSION} is")
    if check:
        validate(spark, path)
    return Snapshot(_parts(spark, path, told))


def _parts(spark: SparkSession, path: str, told: dict) -> DataFrame:
    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{path}/parsed")


def validate(spark: SparkSession, path: str) -> dict:
    """The manifest, if counts and checksum of the parts, read with its columns, are what it says; else WireError."""
    told = manifest(spark, path)
    found = _summary(_parts(spark, path, told))
    wrong = [k for k, v in found.items() if told.get(k) != v]
    if wrong:
        raise WireError(f"not what the manifest says: {', '.join(wrong)}")
    return told


class Cache:
    """Snapshots by key in a shared folder; the oldest go when `most` bytes are passed."""

    def __init__(self, spark: SparkSession, folder: str, most: int):
        self.spark, self.folder, self.most = spark, folder, most

    def get(self, key: str) -> Snapshot | None:
        p, fs = _file(self.spark, f"{self.folder}/{key}/manifest.json")
        return open_snapshot(self.spark, f"{self.folder}/{key}") if fs.exists(p) else None

    def put(self, key: str, snapshot: Snapshot) -> Snapshot:
        """Written under a name of its own and renamed, so two writers of one key do no harm."""
        import uuid

        if (held := self.get(key)) is not None:
            return held
        part = f"{self.folder}/.part-{uuid.uuid4().hex}"
        encode(snapshot, part)
        p, fs = _file(self.spark, part)
        if not fs.rename(p, _file(self.spark, f"{self.folder}/{key}")[0]):
            fs.delete(p, True)
        self.collect(keep=key)
        return self.get(key)

    def entries(self) -> list[tuple[str, int, int]]:
        """(key, bytes, time of writing) of each whole snapshot."""
        p, fs = _file(self.spark, self.folder)
        out = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if not name.startswith("."):
                out.append((name, fs.getContentSummary(s.getPath()).getLength(), s.getModificationTime()))
        return out

    def collect(self, keep: str | None = None) -> list[str]:
        """Deletes the oldest snapshots until the rest fits; their names."""
        held, gone = 0, []
        for name, size, _ in sorted(self.entries(), key=lambda e: (e[0] != keep, -e[2], e[0])):
            held += size
            if held > self.most and name != keep:
                p, fs = _file(self.spark, f"{self.folder}/{name}")
                fs.delete(p, True)
                gone.append(name)
        return gone
