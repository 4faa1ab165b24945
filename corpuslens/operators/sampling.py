"""Bounded file samples per repository for language-model review.

Rankings keep a fixed number of rows per group, so Spark drops the rest before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions import paths
from corpuslens.operators.running import running
from corpuslens.rules import sampling as r

MAX_CHARS, FILL_CHARS = 100_000, 50_000
KEYS = ["repo_id", "path"]


def _quotas(files: DataFrame, small: int, medium: int, large: int) -> DataFrame:
    n = F.count("*")
    quota = F.when(n < 50, F.least(F.lit(small), n)).when(n < 500, medium).otherwise(large)
    return files.groupBy("repo_id").agg(quota.cast("int").alias("quota"))


def _leading(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first ``most`` rows of each repository, numbered from 1."""
    rank = F.row_number().over(W.partitionBy("repo_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def _readable(files: DataFrame) -> DataFrame:
    return files.where("content is not null").select(*KEYS, F.length("content").alias("chars"))


def _with_fill(chosen: DataFrame, fill: DataFrame, quotas: DataFrame) -> DataFrame:
    """Chosen files within the quota, then fill files in the slots left."""
    kept = chosen.join(quotas, "repo_id").where("rank <= quota").select(*KEYS, "rank")
    used = kept.groupBy("repo_id").agg(F.count("*").alias("used"))
    rest = (
        fill.join(quotas, "repo_id")
        .join(used, "repo_id", "left")
        .withColumn("used", F.coalesce("used", F.lit(0)))
        .where("rank <= quota - used")
        .select(*KEYS, (F.col("rank") + F.col("used")).alias("rank"))
    )
    return kept.unionByName(rest)


def representative_files(files: DataFrame) -> DataFrame:
    """Telling names and extensions first, then one file from each directory."""
    quotas = _quotas(files, 10, 20, 30)
    name = paths.base_name(F.col("path"))
    ext = F.lower(paths.extension(name))
    patterns = F.array(*[F.lit(p) for p in r.PRIORITY_PATTERNS])
    by_name, by_ext = F.array_position(patterns, name), F.array_position(patterns, ext)
    none = F.lit(len(r.PRIORITY_PATTERNS) + 1)
    pattern_no = F.least(F.when(by_name > 0, by_name).otherwise(none), F.when(by_ext > 0, by_ext).otherwise(none))
    readable = _readable(files).withColumn("pattern_no", pattern_no)
    matching = readable.where((F.col("pattern_no") < none) & (F.col("chars") < MAX_CHARS))
    chosen = _leading(matching, 30, "pattern_no", "path")
    taken = chosen.join(quotas, "repo_id").where("rank <= quota").select(*KEYS)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    folders = (
        readable.join(taken, KEYS, "left_anti")
        .groupBy("repo_id", folder.alias("folder"))
        .agg(F.min(F.when(F.col("chars") < FILL_CHARS, F.col("path"))).alias("path"))
    )
    fill = _leading(folders, 30, "folder").where("path is not null")
    return _with_fill(chosen, fill, quotas)


def _first_pattern(path: Column, patterns: list[str]) -> Column:
    number = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(patterns))):
        number = F.when(F.contains(path, F.lit(pattern)), i).otherwise(number)
    return number


def architecture_files(files: DataFrame, seed: int = 42) -> DataFrame:
    """Files whose path hints at structure, then a repeatable random fill."""
    quotas = _quotas(files, 10, 15, 20)
    readable = _readable(files).withColumn("pattern_no", _first_pattern(F.col("path"), r.ARCHITECTURE_PATTERNS))
    matching = readable.where(F.col("pattern_no").isNotNull() & (F.col("chars") < MAX_CHARS))
    chosen = _leading(matching, 20, "pattern_no", "path")
    taken = chosen.join(quotas, "repo_id").where("rank <= quota").select(*KEYS)
    rest = readable.where(F.col("chars") < FILL_CHARS).join(taken, KEYS, "left_anti")
    shuffled = rest.withColumn("draw", F.xxhash64("repo_id", "path", F.lit(seed)))
    return _with_fill(chosen, _leading(shuffled, 20, "draw", "path"), quotas)


def quality_files(files: DataFrame) -> DataFrame:
    """A spread over the source extensions: first, last or evenly spaced files of each.

    Files are numbered in ranges of (repository, extension, folder, path), so that a repository with most of the
    corpus is numbered by many tasks and folders need no table of their own.
    """
    name = paths.base_name(F.col("path"))
    eligible = (
        files.where("content is not null")
        .select(*KEYS, F.lower(paths.extension(name)).alias("ext"), F.length("content").alias("chars"))
        .where(F.col("ext").isin(r.CODE_EXTENSIONS) & (F.col("chars") < MAX_CHARS))
        .select(*KEYS, "ext")
    )
    placed = running(eligible, ["repo_id", "ext"], [F.regexp_replace("path", "/?[^/]*$", ""), "path"])
    by_ext = placed.groupBy("repo_id", "ext").agg(F.max("position").alias("in_ext"))
    per_repo = by_ext.groupBy("repo_id").agg(F.sum("in_ext").alias("in_repo"), F.count("*").alias("exts"))
    plan = (
        by_ext.join(per_repo, "repo_id")
        .join(_quotas(files, 10, 15, 20), "repo_id")
        .withColumn("share", F.greatest(F.lit(1), F.floor(F.col("quota") / F.col("exts"))))
        .withColumn("take", F.least("share", "in_ext"))
        .withColumn("step", F.greatest(F.lit(1), F.floor(F.col("in_ext") / F.col("take"))))
    )
    numbered = placed.withColumn("at", F.col("position") - 1).join(plan, ["repo_id", "ext"])
    everything = F.col("in_repo") <= F.col("quota")
    wanted = (
        everything
        | (F.col("at") == 0)
        | ((F.col("take") == 2) & (F.col("at") == F.col("in_ext") - 1))
        | ((F.col("take") > 2) & (F.col("at") % F.col("step") == 0))
    )
    picked = _leading(numbered.where(wanted), 20, "ext", "at")
    return picked.where("rank <= quota").select(*KEYS, "rank")


def review_language(files: DataFrame) -> DataFrame:
    """Language of a file for review, "unknown" when its extension says nothing."""
    from corpuslens.operators.facts import lookup_table

    table = lookup_table(files, list(r.REVIEW_LANGUAGE.items()), "ext string, known string")
    ext = F.lower(paths.extension(paths.base_name(F.col("path"))))
    return files.withColumn("ext", ext).join(table, "ext", "left").select(
        *files.columns, F.coalesce("known", F.lit("unknown")).alias("language")
    )
