"""Writing results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.running import running
from corpuslens.sources.manifests import Versioned

FILE_BYTES = 128 << 20
MOST_FILES_LISTED = 4096
SCHEMA = "repo_id string, document string"


class DocumentFolder(Versioned):
    """Documents by repository in files of bounded size, replaced as a whole in two phases.

    A write first puts its files, in the order of ``repo_id`` and each of at most ``file_bytes`` bytes of
    text and one document more, under a new name, and beside them a table of the files with their first
    and last keys, counted from what was written.  Only then does it create the next manifest: until
    then, and for ever if it dies, readers have the version before.  The manifest fails if another writer
    has created it.  Earlier versions stay readable.
    """

    def __init__(self, spark: SparkSession, location: str, file_bytes: int = FILE_BYTES) -> None:
        super().__init__(spark, location)
        self.file_bytes = file_bytes

    def write(self, documents: DataFrame) -> int:
        """Replace the documents by these (repo_id, document); returns the new version.

        Repeated keys stay, each with its document; a null key comes first, a null document stays null.
        """
        version, part = self.version(), uuid.uuid4().hex
        rows = documents.select(F.col("repo_id").cast("string").alias("repo_id"), F.col("document").cast("string").alias("document"))
        rows = rows.withColumn("bytes", F.coalesce(F.octet_length("document"), F.lit(0)))
        placed = running(rows, [], ["repo_id", "document"], sums={"end": "bytes"})
        number = F.floor(F.greatest(F.col("end") - 1, F.lit(0)) / self.file_bytes)
        dealt = placed.select("repo_id", "document", number.alias("file")).repartition("file").sortWithinPartitions("file", "repo_id", "document")
        data = f"{self.location}/parts/{part}"
        dealt.write.partitionBy("file").parquet(data)
        stored = self.spark.read.schema(f"{SCHEMA}, file long").parquet(data)
        size = F.coalesce(F.sum(F.octet_length("document")), F.lit(0)).alias("bytes")
        files = stored.groupBy("file").agg(F.min("repo_id").alias("first"), F.max("repo_id").alias("last"), F.count_if(F.col("repo_id").isNull()).alias("nulls"), F.count("*").alias("rows"), size)
        files.write.parquet(f"{self.location}/files/{part}")
        written, meant = self._file_table(part).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], placed.count()
        if written != meant:
            raise RuntimeError(f"{written} of {meant} documents were written")
        if not self._committed(version + 1, [part]):
            raise RuntimeError("another writer was first")
        return version + 1

    def _file_table(self, part: str) -> DataFrame:
        schema = "file long, first string, last string, nulls long, rows long, bytes long"
        return self.spark.read.schema(schema).parquet(f"{self.location}/files/{part}")

    def files(self, version: int | None = None) -> DataFrame:
        """(file, first, last, nulls, rows, bytes) of a version that was written."""
        return self._file_table(self.parts(version)[0])

    def documents(self, version: int | None = None) -> DataFrame:
        """(repo_id, document) of a version (default: the last); none before the first write."""
        parts = self.parts(version)
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(f"{SCHEMA}, file long").parquet(f"{self.location}/parts/{parts[0]}").select("repo_id", "document")

    def lookup(self, keys: list[str]) -> DataFrame:
        """(repo_id, document) of given repositories, from the files whose range of keys holds one."""
        parts = self.parts()
        if not parts or not keys:
            return self.spark.createDataFrame([], SCHEMA)
        wanted = F.array(*[F.lit(k) for k in sorted(set(keys))])
        holds = F.exists(wanted, lambda k: k.between(F.col("first"), F.col("last")))
        found = self._file_table(parts[0]).where(holds).select("file").limit(MOST_FILES_LISTED + 1).collect()
        stored = self.spark.read.schema(f"{SCHEMA}, file long").parquet(f"{self.location}/parts/{parts[0]}")
        if len(found) <= MOST_FILES_LISTED:  # else no file is left out
            stored = stored.where(F.col("file").isin([f["file"] for f in found]))
        return stored.where(F.col("repo_id").isin(sorted(set(keys)))).select("repo_id", "document")


def write_documents(documents: DataFrame, target: str) -> str:
    """JSON lines, one document per repository."""
    documents.select("document").write.mode("overwrite").text(target)
    return target


def write_reports(reports: DataFrame, target: str) -> str:
    """JSON lines of (repo_id, report), as many files as tasks, however many repositories there are."""
    reports.select("repo_id", "report").write.mode("overwrite").json(target)
    return target


def write_landscape(counts: DataFrame, target: str, fmt: str = "json") -> str:
    """Landscape counts, one folder per category."""
    counts.write.mode("overwrite").partitionBy("category").format(fmt).save(target)
    return target
