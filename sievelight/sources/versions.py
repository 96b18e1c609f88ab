"""A chunk table whose documents are replaced and deleted as versions: readers see a commit whole or not at all."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "_version"


class ChunkTable:
    """Chunks under ``path``, one live version per document.

    A change is staged first: a new folder gets its chunks and the ids of the
    documents that it settles, those left without chunks included (tombstones).
    Then a commit file takes the next number by a rename that never overwrites;
    it is the only thing that readers go by.  So a change that dies before its
    commit leaves the old state, one that runs again with the same ``batch`` does
    nothing, and of two writers one fails.  ``compact`` writes the live chunks as
    one folder, from which later readers start.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def commits(self) -> list[dict]:
        """All commits by number, from the last compaction on."""
        fs, folder = self._files(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        found = [self._commit(n) for n in sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))]
        base = max((i for i, c in enumerate(found) if c["compacted"]), default=0)
        return found[base:]

    def read(self, version: int | None = None) -> DataFrame:
        """Chunks of the newest version, or of an older one that no compaction has replaced."""
        commits = [c for c in self.commits() if version is None or c["version"] <= version]
        if not commits:
            raise FileNotFoundError(f"{self.path} has no version to read")
        settled = [self.spark.read.parquet(f"{self.path}/data/{c['folder']}/settled") for c in commits]
        newest = reduce(DataFrame.unionByName, settled).groupBy(self.key).agg(F.max(VERSION).alias(VERSION))
        parts = [self.spark.read.parquet(f"{self.path}/data/{c['folder']}/chunks") for c in commits if c["has_chunks"]]
        if not parts:
            return self.spark.read.parquet(f"{self.path}/data/{commits[-1]['folder']}/chunks").drop(VERSION)
        chunks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return chunks.join(newest, [self.key, VERSION], "left_semi").drop(VERSION)

    def replace(self, incoming: DataFrame, docs: DataFrame | None = None, batch: int | None = None) -> int:
        """Put ``incoming`` chunks in place of all that ``docs(key)`` (by default their documents) had; the new version."""
        docs = incoming.select(self.key) if docs is None else docs.select(self.key).unionByName(incoming.select(self.key))
        return self._write(incoming, docs, False, batch)

    def delete(self, docs: DataFrame) -> int:
        """Take the documents of ``docs(key)`` away."""
        return self._write(self.read().limit(0), docs.select(self.key), False, None)

    def compact(self) -> int:
        """The live chunks as one folder; documents without chunks are forgotten."""
        live = self.read()
        return self._write(live, live.select(self.key), True, None)

    def _write(self, chunks: DataFrame, docs: DataFrame, compacted: bool, batch: int | None) -> int:
        commits = self.commits()
        done = [c["version"] for c in commits if batch is not None and c["batch"] is not None and c["batch"] >= batch]
        if done:
            return done[0]
        version = commits[-1]["version"] + 1 if commits else 0
        folder = f"{version:09d}-{uuid.uuid4().hex}"
        stage = f"{self.path}/data/{folder}"
        chunks.withColumn(VERSION, F.lit(version).cast("long")).write.parquet(f"{stage}/chunks")
        docs.distinct().withColumn(VERSION, F.lit(version).cast("long")).write.parquet(f"{stage}/settled")
        has_chunks = not self.spark.read.parquet(f"{stage}/chunks").isEmpty()
        batches = [c["batch"] for c in commits if c["batch"] is not None]
        self._commit_as(version, {"version": version, "folder": folder, "compacted": compacted, "has_chunks": has_chunks, "batch": max([*batches, *([] if batch is None else [batch])], default=None)})
        return version

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _commit(self, name: str) -> dict:
        fs, where = self._files(f"{self.path}/commits/{name}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit_as(self, version: int, content: dict) -> None:
        jvm = self.spark._jvm
        fs, staged = self._files(f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        _, final = self._files(f"{self.path}/commits/{version:09d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(fs.makeQualified(staged), fs.makeQualified(final), no_options)
