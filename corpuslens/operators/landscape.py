"""Technology counts over all repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Architecture is not counted.
COUNTED = ["languages", "frameworks", "databases", "frontend", "build_systems", "package_managers", "devops", "testing"]


def contributions(stack: DataFrame, primary: DataFrame, above: float = 50.0) -> DataFrame:
    """(repo_id, category, tech): what each repository counts for; a row counts once more for every time it occurs."""
    confident = stack.where((F.col("confidence") > above) & F.col("category").isin(COUNTED)).select("repo_id", "category", "tech")
    leading = primary.where(F.col("category").isin("languages", "frameworks"))
    return confident.unionByName(leading.select("repo_id", F.concat(F.lit("primary_"), "category").alias("category"), "tech"))


def landscape_counts(stack: DataFrame, primary: DataFrame, above: float = 50.0) -> DataFrame:
    """Repositories per technology detected with high confidence, and per primary language/framework."""
    return contributions(stack, primary, above).groupBy("category", "tech").agg(F.count("*").alias("n_repos"))


def landscape_top(counts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent technologies of each category."""
    order = W.partitionBy("category").orderBy(F.desc("n_repos"), "tech")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def chart_rows(stack: DataFrame, primary: DataFrame) -> DataFrame:
    """Confidence per technology with its rank and whether it is the primary one."""
    order = W.partitionBy("repo_id", "category").orderBy(F.desc("confidence"), F.desc("matches"), "tech")
    flagged = primary.select("repo_id", "category", "tech", F.lit(True).alias("is_primary"))
    return stack.join(flagged, ["repo_id", "category", "tech"], "left").select(
        "repo_id", "category", "tech", "confidence", F.coalesce("is_primary", F.lit(False)).alias("is_primary"),
        F.row_number().over(order).alias("rank"),
    )
