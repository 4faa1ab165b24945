"""Writing a table of files as trees of repositories, at once or in portions that are read one after another."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.running import running
from corpuslens.session import shared_directory

FILES_AT_ONCE = 1_000_000
BYTES_KEPT = 24 << 30  # of disk that trees take before some are removed
BLOCK = 4096  # of a disk; a folder and a text that is not shared take one at least
LINKS = 30_000  # names of one text; file systems allow different numbers
TEXTS = 100_000  # whose first file a task remembers
FILES_PER_RUN = 1000  # neighbours that one task writes, so that few tasks meet in a folder


def write_tree(files: DataFrame, target: str, share_texts: bool = False) -> int:
    """Write (repo_id, path, content) rows as ``target``/repo_id/path, a ``.git`` folder beside each repository's files.

    Returns about how many bytes of disk they take.  Tasks write their own rows; a task that runs again writes the
    same files.  Null contents become empty files.  With ``share_texts`` equal texts of a task are names (hard links)
    of one file where the file system is local, for trees that nobody edits; writing a tree again parts them.
    """
    columns, uri = files.select("repo_id", "path", "content"), _uri(target)

    def write(batches):
        from pyarrow import fs

        client, top = fs.FileSystem.from_uri(uri)
        local, made, first = isinstance(client, fs.LocalFileSystem), set(), {}
        for batch in batches:
            taken = 0
            for repo_id, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                location = f"{top}/{repo_id}/{path}"
                for folder in (f"{top}/{repo_id}/.git", location.rsplit("/", 1)[0]):
                    if folder not in made:
                        client.create_dir(folder, recursive=True)
                        made.add(folder)
                        taken += BLOCK
                body = (content or "").encode()
                if local and share_texts:
                    digest = hashlib.sha256(body).digest()
                    source, links = first.get(digest, (None, 0))
                    if source is not None and links < LINKS and _linked(source, location):
                        first[digest] = source, links + 1
                        continue
                    if len(first) >= TEXTS:
                        first.clear()
                    first[digest] = location, 1
                if local:
                    _write_new(location, body)
                else:
                    with client.open_output_stream(location) as stream:
                        stream.write(body)
                taken += -(-len(body) // BLOCK) * BLOCK
            yield pa.RecordBatch.from_arrays([pa.array([taken], pa.int64())], names=["taken"])

    from pyarrow import fs

    root, top = fs.FileSystem.from_uri(uri)
    root.create_dir(top, recursive=True)
    return columns.mapInArrow(write, "taken long").agg({"taken": "sum"}).first()[0] or 0


def _linked(source: str, location: str) -> bool:
    """Make ``location`` a name of the file ``source`` instead of what it was; False where that cannot be."""
    for _ in range(2):
        try:
            os.link(source, location)
            return True
        except FileExistsError:  # written by an earlier attempt, or twice in the table
            os.unlink(location)
        except OSError:
            return False
    return False


def _write_new(location: str, body: bytes) -> None:
    """Write a file that shares nothing with what had its name before."""
    if os.path.lexists(location):
        os.unlink(location)
    with open(location, "xb", buffering=0) as stream:
        stream.write(body)


def _uri(location: str) -> str:
    return location if "://" in location or location.startswith("file:") else f"file://{location}"


def remove_tree(repositories: DataFrame, target: str) -> None:
    """Delete what ``write_tree`` wrote for the rows' ``repo_id``, each task its own repositories, then the root."""
    from pyarrow import fs

    uri = _uri(target)

    def remove(batches):
        client, top = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for repo_id in batch.column(0).to_pylist():
                client.delete_dir_contents(f"{top}/{repo_id}", missing_dir_ok=True)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    tasks = 4 * repositories.sparkSession.sparkContext.defaultParallelism
    repositories.select("repo_id").distinct().repartition(tasks).mapInArrow(remove, "n long").agg({"n": "sum"}).collect()
    client, top = fs.FileSystem.from_uri(uri)
    client.delete_dir(top)


def through_trees(
    files: DataFrame, read: Callable[[str], DataFrame], files_at_once: int = FILES_AT_ONCE, bytes_kept: int = BYTES_KEPT,
) -> DataFrame:
    """What ``read`` finds in the trees of all files, a written table; each tree holds ``files_at_once`` files at most.

    Removing a file takes longer than writing and reading it, and slows what is written next.  So trees stay, as other
    written tables do, while they and one more like the last take ``bytes_kept`` of disk; beyond that the oldest go.

    Files are taken in the order of repositories and paths.  A repository may lie in several portions, each a tree
    with its own ``.git``, so ``read`` must look at files one by one.
    """
    spark = files.sparkSession
    folder = f"{shared_directory(spark)}/corpuslens/trees-{uuid.uuid4().hex}"
    placed = running(files.select("repo_id", "path", "content"), [], ["repo_id", "path"])
    placed.withColumn("portion", F.floor((F.col("position") - 1) / files_at_once)).write.partitionBy("portion").parquet(f"{folder}/files")
    dealt = spark.read.schema("repo_id string, path string, content string, position bigint, portion bigint").parquet(f"{folder}/files")
    tasks, kept, taken = 4 * spark.sparkContext.defaultParallelism, [], 0
    # Of an empty table the empty tree is read, for its columns.
    for portion in sorted(r["portion"] for r in dealt.select("portion").distinct().collect()) or [0]:
        while kept and sum(b for _, _, b in kept) + taken > bytes_kept:
            remove_tree(*kept.pop(0)[:2])
        rows, target = dealt.where(F.col("portion") == portion), f"{folder}/tree-{portion}"
        taken = write_tree(rows.repartition(tasks, F.floor(F.col("position") / FILES_PER_RUN)), target, share_texts=True)
        kept.append((rows, target, taken))
        found = read(target)
        found.write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema(found.schema).parquet(f"{folder}/found")
