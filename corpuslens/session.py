"""Session settings and shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("corpuslens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_directory(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in a single local process, as in tests."""
    configured = spark.conf.get(CHECKPOINT_SETTING, "") or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several jobs read to the shared folder and return the written table.

    The written table replaces the lineage: losing executors never repeats the work behind it, and
    readers get column pruning and file statistics.
    """
    spark = df.sparkSession
    target = f"{shared_directory(spark)}/corpuslens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
