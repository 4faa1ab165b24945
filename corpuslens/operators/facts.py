"""Facts about a repository that come from its paths alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions import paths
from corpuslens.functions.text import manifest_sections
from corpuslens.operators.scan import test_directory
from corpuslens.rules import architecture, frameworks, languages, testing
from corpuslens.session import materialize


def lookup_table(df: DataFrame, rows: list[tuple], schema: str, limit: int = 50_000) -> DataFrame:
    """A small rule table next to ``df``; broadcast while its row count stays under ``limit``."""
    table = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= limit else table


def _files(rows: DataFrame) -> Column:
    """How many files a row stands for: one, or what ``scan.file_groups`` counted."""
    return F.col("files") if "files" in rows.columns else F.lit(1)


def _counted(rows: DataFrame, condition: Column) -> Column:
    return F.sum(F.when(condition, _files(rows)).otherwise(0))


def language_counts(files: DataFrame) -> DataFrame:
    """Weighted files per language: three for a telling file name, else one for the extension."""
    names = lookup_table(files, list(languages.SPECIAL_FILES.items()), "name string, special string")
    endings = lookup_table(files, list(languages.EXTENSIONS.items()), "ext string, usual string")
    name = paths.base_name(F.col("path"))
    return (
        files.select("repo_id", name.alias("name"), F.lower(paths.extension(name)).alias("ext"), _files(files).alias("n"))
        .join(names, "name", "left")
        .join(endings, "ext", "left")
        .select(
            "repo_id",
            F.coalesce("special", "usual").alias("tech"),
            (F.when(F.col("special").isNotNull(), 3).otherwise(1) * F.col("n")).alias("weight"),
        )
        .where("tech is not null")
        .groupBy("repo_id", "tech")
        .agg(F.sum("weight").cast("double").alias("points"))
    )


def dominant_languages(files: DataFrame, share: float = 0.1) -> DataFrame:
    """Languages with more than a tenth of the readable source files of a repository."""
    table = lookup_table(
        files, list(frameworks.SOURCE_LANGUAGE.items()), "ext string, language string"
    )
    counts = (
        files.where("content is not null")
        .select("repo_id", paths.loose_extension(F.col("path")).alias("ext"))
        .join(table, "ext")
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(W.partitionBy("repo_id"))
    return counts.withColumn("total", total).where(F.col("n") > share * F.col("total")).select("repo_id", "language", "n")


def files_by_extension(files: DataFrame) -> DataFrame:
    """Files per lower-cased extension; files without one are left out."""
    ext = F.lower(paths.extension(paths.base_name(F.col("path"))))
    return files.select("repo_id", ext.alias("ext")).where("ext <> ''").groupBy("repo_id", "ext").agg(
        F.count("*").alias("n")
    )


def test_source_ratio(files: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Extensions with at least half as many files in test directories as outside."""
    in_tests = test_directory(F.col("path"), testing.TEST_DIRECTORIES).isNotNull()
    ext = paths.extension(paths.base_name(F.col("path")))
    counts = (
        files.select("repo_id", ext.alias("ext"), in_tests.alias("in_tests"), _files(files).alias("files"))
        .where("ext <> ''")
        .groupBy("repo_id", "ext")
        .agg(
            F.sum(F.when(F.col("in_tests"), F.col("files")).otherwise(0)).alias("tests"),
            F.sum(F.when(F.col("in_tests"), 0).otherwise(F.col("files"))).alias("sources"),
        )
    )
    return counts.where((F.col("tests") > 0) & (F.col("sources") > 0) & (F.col("tests") >= minimum * F.col("sources")))


def component_counts(files: DataFrame) -> DataFrame:
    """Files per repository that look like a component of a layered architecture."""
    lower = F.lower("path")
    counts = [
        _counted(files, reduce(Column.__or__, [F.contains(lower, F.lit(w)) for w in words])).alias(name)
        for name, words in architecture.COMPONENTS.items()
    ]
    in_features = F.contains("path", F.lit("/features/")) | F.contains("path", F.lit("/modules/"))
    return files.groupBy("repo_id").agg(*counts, _counted(files, in_features).alias("feature_files"))


def service_directories(files: DataFrame) -> DataFrame:
    """Distinct entries directly under ``services/`` or ``microservices/`` per repository."""
    parts = F.split("path", "/")
    return (
        files.select("repo_id", parts.alias("parts"))
        .where((F.size("parts") >= 2) & F.get("parts", F.lit(0)).isin("services", "microservices"))
        .groupBy("repo_id", F.get("parts", F.lit(1)).alias("service"))
        .agg(F.lit(1).alias("one"))
        .groupBy("repo_id")
        .agg(F.count("*").alias("services"))
    )


def directory_frequency(files: DataFrame) -> DataFrame:
    """How often a directory name occurs within the first three levels of the paths."""
    first_levels = F.slice(paths.directory_parts(F.col("path")), 1, 3)
    return (
        files.select("repo_id", F.explode(first_levels).alias("name"))
        .where("name <> ''")
        .groupBy("repo_id", "name")
        .agg(F.count("*").alias("n"))
    )


def feature_modules(files: DataFrame) -> DataFrame:
    """Repositories with at least three busy directories of similar make-up.

    A directory name is busy above five files in the first three levels.  All of them must be
    first-level directories that share an extension with the first one (by name).
    """
    busy = directory_frequency(files).where(
        (F.col("n") > 5) & ~F.col("name").isin(architecture.GENERIC_DIRECTORIES)
    )
    busy = materialize(busy, "busy-directories")  # few rows that are read several times
    per_repo = busy.groupBy("repo_id").agg(F.count("*").alias("modules"), F.min("name").alias("first_name"))
    several = per_repo.where("modules >= 3")
    path = F.col("path")
    kinds = (
        files.select(
            "repo_id",
            paths.first_level_directory(path).alias("name"),
            paths.extension(paths.base_name(path)).alias("ext"),
        )
        .where("name is not null")
        .groupBy("repo_id", "name", "ext")
        .agg(F.lit(1).alias("one"))
        .drop("one")
        .join(busy.select("repo_id", "name"), ["repo_id", "name"], "left_semi")
    )
    pattern = (
        kinds.join(several, "repo_id").where("name = first_name").select("repo_id", "ext", "modules")
    )
    alike = (
        kinds.join(pattern, ["repo_id", "ext"])
        .groupBy("repo_id", "name", "modules")
        .agg(F.lit(1).alias("one"))
        .groupBy("repo_id", "modules")
        .agg(F.count("*").alias("similar"))
        .where("similar = modules")
    )
    ranked = busy.withColumn("rn", F.row_number().over(W.partitionBy("repo_id").orderBy("name"))).where("rn <= 5")
    names = ranked.groupBy("repo_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "name"))), lambda s: s["name"]), ", ").alias("first_names")
    )
    return alike.join(names, "repo_id").select("repo_id", "modules", "first_names")


def repository_facts(files: DataFrame) -> DataFrame:
    """One row per repository: file counts and the signs that recommendations look for."""
    path, lower = F.col("path"), F.lower("path")
    return files.groupBy("repo_id").agg(
        F.count("*").alias("file_count"),
        F.count("content").alias("content_count"),
        F.bool_or(F.contains(path, F.lit(".git"))).alias("has_git"),
        F.bool_or(F.endswith(path, F.lit(".md")) | F.endswith(path, F.lit(".rst"))).alias("has_docs"),
        F.bool_or(
            F.contains(path, F.lit(".github/workflows")) | F.contains(lower, F.lit("jenkins")) | F.contains(lower, F.lit("gitlab-ci"))
        ).alias("has_ci"),
    )


def first_manifests(hits: DataFrame) -> DataFrame:
    """Whether the first package manifest of a repository, by path, declares dependencies."""
    first = F.min(F.struct("path", "tech"))
    return hits.where("detector = 'manifest'").groupBy("repo_id").agg((first["tech"] == "declares").alias("first_manifest_declares"))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(repo, path, section, package) rows of package manifests; malformed ones give none."""
    parsed = files.where("content is not null").where(paths.base_name(F.col("path")) == "package.json").select(
        "repo_id", "path", F.length("content").alias("chars"), manifest_sections(F.col("content")).alias("parsed")
    )
    sections = [
        F.struct(F.lit(s).alias("section"), F.map_keys(F.col("parsed")[s]).alias("packages"))
        for s in ("dependencies", "devDependencies")
    ]
    return parsed.select("repo_id", "path", "chars", F.inline(F.array(*sections))).select(
        "repo_id", "path", "chars", "section", F.explode("packages").alias("package")
    )
