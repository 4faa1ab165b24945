"""Repositories in a file system as a Spark data source.

1. ``list_tree`` lists folders in rounds over a frontier: every round is a job in which each task lists a bounded
   number of folders below those it was given and hands the rest on, so that one deep or wide repository is listed
   by many tasks and nothing but the root's own entries passes the driver.
2. ``write_listing`` deals the listed files into buckets of about equal bytes, a running total over all of them, and
   writes a Parquet file per bucket.
3. The data source ``repository_files`` plans a partition per bucket.  Filters on names, folders, sizes and
   readability reach its reader, which applies them to the listing before it opens a file.  A file that cannot be
   read is a row with its ``error``.

Spark's own file sources skip names that start with a dot, which here are evidence.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from corpuslens.functions import paths
from corpuslens.operators.running import running
from corpuslens.rules import eligibility as e
from corpuslens.session import materialize

FOLDERS_PER_START = 256
BUCKET_BYTES = 128 << 20
FILE_COST = 64 << 10  # what opening a file costs, in bytes read
BATCH_BYTES = 16 << 20
BATCH_ROWS = 1000
FORMAT = "repository_files"
SCHEMA = "repo_id string, path string, name string, extension string, size bigint, readable boolean, content string, error string"
_WALKED = "repo_id string, prefix bigint, location string, size bigint, is_folder boolean, error string"


def _client(base: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(base)[0]


def _children(files, local: bool, folder: str, skipped: frozenset) -> Iterator:
    """Entries of a folder: excluded folders and, in a local file system, links to folders are left out."""
    from pyarrow import fs

    for info in files.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.Directory and (info.base_name in skipped or local and os.path.islink(info.path)):
            continue
        yield info, info.type == fs.FileType.Directory


def list_tree(spark: SparkSession, root: str, excluded: list[str] | None = None, folders_per_start: int = FOLDERS_PER_START) -> DataFrame:
    """(repo_id, path, size, location, base, error) of every file below ``root``, excluded folders pruned.

    A folder holding ``.git`` is a repository (named "." when it is the root), as is a child of the root holding one;
    without any ``.git`` the root as a whole is one.  A folder that cannot be listed is a row with its ``error``.
    """
    from pyarrow import fs

    base = root if "://" in root or root.startswith("file:") else os.path.abspath(root)
    files, top = fs.FileSystem.from_uri(base)
    local, skipped = isinstance(files, fs.LocalFileSystem), frozenset(e.EXCLUDED_DIRECTORIES if excluded is None else excluded)
    tasks = 4 * spark.sparkContext.defaultParallelism
    whole = files.get_file_info(f"{top}/.git").type == fs.FileType.Directory
    if not whole:
        children = [(info.path,) for info, is_folder in _children(files, local, top, skipped) if is_folder]

        def marked(batches):
            client = _client(base)
            for batch in batches:
                found = client.get_file_info([f"{f}/.git" for f in batch["location"]]) if len(batch) else []
                yield batch[[i.type == fs.FileType.Directory for i in found]]

        repositories = None
        if children:
            folders = spark.createDataFrame(children, "location string").repartition(min(len(children), tasks))
            repositories = materialize(folders.mapInPandas(marked, "location string"), "repositories")
        whole = repositories is None or repositories.isEmpty()
    if whole:
        frontier = spark.createDataFrame([(".", len(top.rstrip("/")) + 1, top.rstrip("/"))], "repo_id string, prefix bigint, location string")
    else:
        frontier = repositories.select(F.element_at(F.split("location", "/"), -1).alias("repo_id"), (F.length("location") + 1).cast("bigint").alias("prefix"), "location")

    def walk(batches):
        client = _client(base)
        for batch in batches:
            rows: list[tuple] = []
            for repo_id, prefix, start in zip(batch["repo_id"], batch["prefix"], batch["location"], strict=True):
                pending, listed = deque([start]), 0
                while pending and listed < folders_per_start:
                    folder, listed = pending.popleft(), listed + 1
                    try:
                        for info, is_folder in _children(client, local, folder, skipped):
                            if is_folder:
                                pending.append(info.path)
                            else:
                                rows.append((repo_id, prefix, info.path, info.size or 0, False, None))
                    except OSError as problem:
                        rows.append((repo_id, prefix, folder + "/", 0, False, str(problem)))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows = []
                rows += [(repo_id, prefix, folder, 0, True, None) for folder in pending]
            if rows:
                yield pd.DataFrame(rows, columns=_NAMES)

    found = None
    while True:
        # Starting points are dealt one by one: those of a round come from few tasks.
        walked = materialize(frontier.repartition(tasks, "location").mapInPandas(walk, _WALKED), "walked")
        listed = walked.where("not is_folder")
        found = listed if found is None else found.unionByName(listed)
        frontier = walked.where("is_folder").select("repo_id", "prefix", "location")
        if frontier.isEmpty():
            break
    path = F.expr("substring(location, cast(prefix as int) + 1)")
    return found.select("repo_id", path.alias("path"), "size", "location", F.lit(base).alias("base"), "error")


_NAMES = [part.split(" ")[0] for part in _WALKED.split(", ")]


def write_listing(listed: DataFrame, target: str, readable, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The listing with names, extensions and readability, a Parquet file per bucket of about ``bucket_bytes``.

    Files are taken in the order of their repositories and paths, so that a bucket holds few repositories.
    """
    name = paths.base_name(F.col("path"))
    rows = listed.select(
        "repo_id", "path", name.alias("name"), F.lower(paths.extension(name)).alias("extension"), F.col("size").cast("bigint").alias("size"),
        (readable(name) & F.col("error").isNull()).alias("readable"), "location", "base", "error", (F.col("size") + FILE_COST).alias("weight"),
    )
    placed = running(rows, [], ["repo_id", "path"], sums={"so_far": "weight"}).withColumn("bucket", F.floor((F.col("so_far") - 1) / bucket_bytes))
    kept = placed.drop("weight", "so_far", "position")
    kept.repartition("bucket").write.partitionBy("bucket").parquet(target)
    return listed.sparkSession.read.schema(kept.schema).parquet(target).drop("bucket")


@dataclass
class Bucket(ds.InputPartition):
    location: str


class RepositoryFiles(ds.DataSource):
    """``spark.read.format("repository_files").option("listing", folder)``: the files of a written listing, with their texts."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return RepositoryReader(self.options["listing"])


_COMPARED = {
    "EqualTo": lambda c, v: c == v, "In": lambda c, v: c.isin(list(v)), "GreaterThan": lambda c, v: c > v, "GreaterThanOrEqual": lambda c, v: c >= v,
    "LessThan": lambda c, v: c < v, "LessThanOrEqual": lambda c, v: c <= v,
}
_TEXT = {"StringStartsWith": "starts_with", "StringEndsWith": "ends_with", "StringContains": "match_substring"}


class RepositoryReader(ds.DataSourceReader):
    """A partition per bucket; filters on the listing's columns decide which files are opened."""

    def __init__(self, listing: str) -> None:
        self.listing = listing
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for each in filters:
            kind, column = type(each).__name__, each.attribute[0] if hasattr(each, "attribute") else ""
            if column in ("repo_id", "path", "name", "extension", "size", "readable") and kind in (*_COMPARED, *_TEXT):
                self.pushed.append((kind, column, each.value))
            elif kind != "IsNotNull" or column not in ("repo_id", "path", "name", "extension", "size", "readable"):
                yield each  # columns of the listing are never null

    def partitions(self) -> list[Bucket]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(self.listing)
        found = files.get_file_info(fs.FileSelector(folder, recursive=True))
        return [Bucket(i.path) for i in found if i.type == fs.FileType.File and i.base_name.endswith(".parquet")] or [Bucket("")]

    def _condition(self):
        import pyarrow.compute as pc

        condition = pc.scalar(True)
        for kind, column, value in self.pushed:
            field = pc.field(column)
            condition &= _COMPARED[kind](field, value) if kind in _COMPARED else getattr(pc, _TEXT[kind])(field, pattern=value)
        return condition

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as pads

        if not partition.location:
            return
        names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        rows: list[tuple] = []
        held = 0
        client = None
        bucket = pads.dataset(partition.location, filesystem=_client(self.listing), format="parquet", partitioning=None)
        for batch in bucket.to_batches(filter=self._condition()):
            for row in batch.to_pylist():
                content, error = None, row["error"]
                if error is None:
                    client = client or _client(row["base"])
                    content, error = _text_of(client, row["location"])
                rows.append((*(row[n] for n in names[:6]), content, error))
                held += len(content or "")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _text_of(files, location: str) -> tuple[str | None, str | None]:
    """(text, error): malformed bytes dropped, line ends unified."""
    try:
        with files.open_input_stream(location) as stream:
            body = stream.read().decode("utf-8", errors="ignore")
    except OSError as problem:
        return None, str(problem)
    return body.replace("\r\n", "\n").replace("\r", "\n"), None


def open_listing(spark: SparkSession, listing: str) -> DataFrame:
    """The files of a written listing with (repo_id, path, name, extension, size, readable, content, error)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositoryFiles)
    return spark.read.format(FORMAT).option("listing", listing).load()
