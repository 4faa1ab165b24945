"""Reading a corpus: files of many repositories as rows of (repo_id, path, size, content)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import paths, text
from corpuslens.rules import eligibility as e
from corpuslens.session import materialize, shared_directory
from corpuslens.sources import repositories

ALL = ["*"]


def readable_name(name: Column, extensions: list[str] | None = None) -> Column:
    """File types whose content is loaded, by lower-cased extension or exact name.

    ``extensions`` replaces the list in ``rules.eligibility``; ``ALL`` loads every name without a binary extension,
    an empty list only the names that are loaded always.
    """
    ext = F.lower(paths.extension(name))
    binary = ext.isin(e.BINARY_EXTENSIONS)
    if extensions is not None and "*" in extensions:
        return ~binary
    extensions = e.CONTENT_EXTENSIONS if extensions is None else extensions
    # The extension decides most names by itself, so that it is worked out once for them.
    return ext.isin([x for x in extensions if x not in e.BINARY_EXTENSIONS]) | (name.isin(extensions + e.CONTENT_NAMES) & ~binary)


def _wanted(name: Column, extensions: list[str] | None, max_file_bytes: int | None) -> Column:
    named = readable_name(name, extensions)
    return named if max_file_bytes is None else named & (F.col("size") <= max_file_bytes)


def eligible_content(
    files: DataFrame,
    max_file_bytes: int | None = None,
    extensions: list[str] | None = None,
) -> DataFrame:
    """Keep every file but null the content of those that are not read.

    Name and size are decided first, so the text checks run only on what is left.  The name stands once in the
    expression: filters on the content repeat it, and inside them nothing is shared.
    """
    name, content = paths.base_name(F.col("path")), F.col("content")
    usable = _wanted(name, extensions, max_file_bytes) & ~text.is_binary_text(content) & ~text.is_blank(content)
    return files.select("repo_id", "path", "size", F.when(usable, content).alias("content"))


def exclude_directories(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Drop files under an excluded directory; a *file* of that name stays."""
    return files.where(~paths.in_excluded_directory(F.col("path"), excluded or e.EXCLUDED_DIRECTORIES))


def exclude_files(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop files whose name matches a shell-style pattern such as ``*.min.js``."""
    name = paths.base_name(F.col("path"))
    for pattern in patterns:
        files = files.where(~F.like(name, F.lit(pattern.replace("_", r"\_").replace("*", "%").replace("?", "_"))))
    return files


def from_table(
    files: DataFrame,
    excluded: list[str] | None = None,
    max_file_bytes: int | None = None,
    exclude_patterns: list[str] | None = None,
    extensions: list[str] | None = None,
) -> DataFrame:
    """Prepare any table with ``repo_id, path, content`` (and optionally ``size``) for analysis."""
    if "size" not in files.columns:
        files = files.withColumn("size", F.octet_length("content").cast("bigint"))
    kept = exclude_directories(files, excluded)
    kept = exclude_files(kept, exclude_patterns or [])
    return eligible_content(kept, max_file_bytes, extensions)


def load_corpus(
    spark: SparkSession,
    root: str,
    excluded: list[str] | None = None,
    max_file_bytes: int | None = None,
    exclude_patterns: list[str] | None = None,
    extensions: list[str] | None = None,
    errors: bool = False,
) -> DataFrame:
    """Read every repository under ``root``, a local or remote file system location.

    The tree is listed by rounds of tasks (``repositories.list_tree``); then two scans are joined by a union: files
    whose name and size ask for their text are read through the data source, where that filter is applied before
    a file is opened, and all others come from the listing alone.  The result is written to the shared folder
    once, so that no file is opened again however often it is used.  With ``errors`` it has a further column
    ``error``: why a file or folder could not be read.
    """
    listing = f"{shared_directory(spark)}/corpuslens/listing-{uuid.uuid4().hex}"
    listed = repositories.list_tree(spark, root, excluded)
    names = repositories.write_listing(listed, listing, lambda name: readable_name(name, extensions))
    wanted = F.col("readable") if max_file_bytes is None else F.col("readable") & (F.col("size") <= max_file_bytes)
    columns = ["repo_id", "path", "size", "content", "error"]
    texts = repositories.open_listing(spark, listing).where(wanted).select(columns)
    others = names.where(~wanted).withColumn("content", F.lit(None).cast("string")).select(columns)
    loaded = materialize(texts.unionByName(others), "corpus")
    kept = from_table(loaded, excluded, max_file_bytes, exclude_patterns, extensions)
    if not errors:
        return kept
    return kept.join(loaded.where("error is not null").select("repo_id", "path", "error"), ["repo_id", "path"], "left")
