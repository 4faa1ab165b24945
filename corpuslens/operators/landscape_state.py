"""Landscape counts that are kept and changed, instead of counted anew over all repositories.

The state is one table of contributions (repo_id, category, tech, n), n the number of equal rows, in buckets
by repository, and one of partial counts (category, tech, n_repos) per bucket.  A change names the
repositories whose analysis is new and those that are withdrawn: only their buckets are read, the rows of
exactly these repositories are taken out and the new ones put in, and only these buckets are written, by
dynamic partition overwrite.  The landscape is the sum of the partial counts, a row per bucket and technology.

A change replaces all that its repositories contributed, so doing it again changes nothing: a job that
failed between the two tables is repaired by repeating it.  Changes by two writers at once are not for
this table; the order in which they reach a bucket decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import materialize

BUCKETS = 64
_ROWS = "bucket int, repo_id string, category string, tech string, n bigint"
_COUNTS = "bucket int, category string, tech string, n_repos bigint"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int").alias("bucket")


class LandscapeState:
    """Counts in the folder ``target``, which starts empty; ``buckets`` must not change afterwards."""

    def __init__(self, spark: SparkSession, target: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self._rows, self._counts = f"{target.rstrip('/')}/contributions", f"{target.rstrip('/')}/counts"

    def _read(self, folder: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def contributions(self) -> DataFrame:
        return self._read(self._rows, _ROWS).drop("bucket")

    def counts(self) -> DataFrame:
        """(category, tech, n_repos), as ``landscape_counts`` over all present repositories."""
        partial = self._read(self._counts, _COUNTS).where("n_repos > 0")
        return partial.groupBy("category", "tech").agg(F.sum("n_repos").alias("n_repos"))

    def apply(self, added: DataFrame, repositories: DataFrame) -> None:
        """Replace what ``repositories`` (repo_id) contribute by their rows in ``added`` (repo_id, category, tech).

        A repository without rows in ``added`` is withdrawn.  Rows of ``added`` for other repositories are
        an error of the caller and are left out.  Repeated and null repositories in the list count once and
        not at all.
        """
        changed = materialize(repositories.select(F.col("repo_id").cast("string").alias("repo_id")).where("repo_id IS NOT NULL").distinct(), "landscape-changed")
        touched = sorted(r["bucket"] for r in changed.select(_bucket(self.buckets)).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        fresh = (
            added.select("repo_id", "category", "tech").join(changed, "repo_id", "left_semi")
            .groupBy("repo_id", "category", "tech").agg(F.count("*").alias("n")).select(_bucket(self.buckets), "*")
        )
        kept = self._read(self._rows, _ROWS).where(F.col("bucket").isin(touched)).join(changed, "repo_id", "left_anti")
        # Written aside first: a partition can't be overwritten while it is read.  A bucket that loses its
        # last row keeps one with n = 0, because dynamic overwrite leaves partitions without rows alone.
        none = self.spark.createDataFrame([(b, None, None, None, 0) for b in touched], _ROWS)
        rows = materialize(kept.where("n > 0").unionByName(fresh).unionByName(none), "landscape-rows")
        counts = rows.groupBy("bucket", "category", "tech").agg(F.sum("n").alias("n_repos"))
        for table, folder in ((rows, self._rows), (counts, self._counts)):
            placed = table.repartition("bucket").sortWithinPartitions("bucket", "category", "tech")
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
