"""Result store: results of expensive calls kept by a key of their input.

A store is a folder with *parts*, one per append, and numbered *manifests*.  A part holds its rows in buckets by the
first letters of the key, a folder each, so that a lookup opens the buckets of its keys alone; every file has a
Bloom filter over its keys, which lets a lookup of given keys skip files of their bucket too.  A manifest names the
parts that belong to a version.  An append writes its part first and then creates the next manifest, which fails
if another writer has created it: the rows that the other one has stored meanwhile are then taken out, and the
append tries again.  So a key is stored once however many writers append, readers see whole versions only, and
an append that dies leaves nothing but an unnamed folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.manifests import Versioned

PREFIX = 2  # 256 buckets of hexadecimal keys, each written by one task per append; larger stores take more letters
_EMPTY = "_"
SCHEMA = "key string, result string"
ATTEMPTS = 100
MOST_LISTED_BUCKETS = 4096


def content_key(content: Column, operation: str = "analysis", extras: str = "", model: str = "gpt-4o") -> Column:
    """MD5 over content, operation, extras and model name."""
    return F.md5(F.concat(content, F.lit(operation + extras + model)))


class ResultStore(Versioned):
    """(key, result) rows in ``location``, any file system of Spark; keys are unique and not null."""

    def __init__(self, spark: SparkSession, location: str, prefix: int = PREFIX) -> None:
        super().__init__(spark, location)
        self.prefix = prefix

    # Rows.

    def _bucket(self) -> Column:
        """First letters of the key; an empty key has a bucket of its own."""
        return F.coalesce(F.nullif(F.substring("key", 1, self.prefix), F.lit("")), F.lit(_EMPTY))

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket string")
        paths = [f"{self.location}/parts/{p}" for p in parts]
        # Each part is read by its own root, so that the bucket is a partition column.
        frames = [self.spark.read.schema(f"{SCHEMA}, bucket string").parquet(p) for p in paths]
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        return whole

    def _write(self, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        dealt = rows.select("key", "result", self._bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "key")
        writer = dealt.write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("bucket")
        writer.parquet(f"{self.location}/parts/{part}")
        return part

    def rows(self, version: int | None = None) -> DataFrame:
        """(key, result) of a version."""
        return self._read(self.parts(version)).select("key", "result")

    def lookup(self, keys: list[str]) -> DataFrame:
        """(key, result) of given keys: from their buckets, and there from files whose Bloom filter may hold one."""
        stored = self._read(self.parts())
        return stored.where(F.col("bucket").isin(sorted({k[: self.prefix] or _EMPTY for k in keys})) & F.col("key").isin(list(keys))).select("key", "result")

    def _wanted(self, keyed: DataFrame) -> DataFrame:
        """The stored rows of all buckets that a table's keys lie in."""
        stored = self._read(self.parts())
        buckets = keyed.where("key is not null").select(self._bucket().alias("bucket")).distinct().limit(MOST_LISTED_BUCKETS + 1).collect()
        if len(buckets) <= MOST_LISTED_BUCKETS:  # else no bucket is left out
            stored = stored.where(F.col("bucket").isin([b["bucket"] for b in buckets]))
        return stored.select("key", "result")

    def with_results(self, keyed: DataFrame) -> DataFrame:
        """Rows with a ``key`` and their stored result, NULL where there is none."""
        return keyed.join(self._wanted(keyed), "key", "left")

    def misses(self, keyed: DataFrame) -> DataFrame:
        """Rows whose key is not stored; reads keys alone."""
        return keyed.join(self._wanted(keyed).select("key"), "key", "left_anti")

    def append(self, results: DataFrame) -> int:
        """Store the results whose key is not stored yet, of several for a key the least; returns the new version.

        Null keys are not stored.  Without any new key nothing is written and the version stays.
        """
        fresh = results.where("key is not null").groupBy("key").agg(F.min("result").alias("result"))
        version = self.version()
        known = self.parts(version)
        part = self._write(fresh.join(self._read(known).select("key"), "key", "left_anti"))
        for _ in range(ATTEMPTS):
            if self._read([part]).isEmpty():
                return version
            if self._committed(version + 1, [*known, part]):
                return version + 1
            version = self.version()
            others = [p for p in self.parts(version) if p not in known]
            known = self.parts(version)
            part = self._write(self._read([part]).join(self._read(others).select("key"), "key", "left_anti"))
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def compact(self) -> int:
        """One part instead of many; fails if another writer appends meanwhile.  Old versions stay readable."""
        version = self.version()
        if len(self.parts(version)) < 2:
            return version
        if not self._committed(version + 1, [self._write(self._read(self.parts(version)))]):
            raise RuntimeError("another writer was first")
        return version + 1


def stored_results(spark: SparkSession, store: str) -> DataFrame:
    """(key, result) rows of a store; an empty frame when it does not exist yet."""
    return ResultStore(spark, store).rows()


def with_results(keyed: DataFrame, stored: DataFrame) -> DataFrame:
    """Input rows with their stored result, NULL where there is none; every input row once."""
    one_each = stored.groupBy("key").agg(F.min("result").alias("result"))
    return keyed.join(one_each, "key", "left")


def misses(keyed: DataFrame, stored: DataFrame) -> DataFrame:
    """Input rows without a stored result."""
    return keyed.join(stored.select("key"), "key", "left_anti")


def append_results(results: DataFrame, store: str) -> None:
    """Append the results whose key is not stored yet."""
    ResultStore(results.sparkSession, store).append(results)
