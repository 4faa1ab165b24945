"""Path columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Extension with its dot, case kept; leading dots of a name do not start one."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def loose_extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the whole path (the whole path if there is none)."""
    return F.lower(F.substring_index(path, ".", -1))


def directory_parts(path: Column) -> Column:
    """Directory components, without the file name."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def ancestor_directories(path: Column) -> Column:
    """Every ancestor directory of a path; hidden roots (leading dot) have none."""
    parts = directory_parts(path)
    every = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    none = F.array().cast("array<string>")
    return F.when(F.size(parts) > 0, F.filter(every, lambda d: (d != "") & ~d.startswith("."))).otherwise(none)


def first_level_directory(path: Column) -> Column:
    """First component of a path, NULL for files at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))


def in_excluded_directory(path: Column, excluded: list[str]) -> Column:
    """True when a directory component (never the file name) is excluded."""
    # One pattern, so that the path is worked out once, however many directories are excluded.
    names = "|".join(re.sub(r"([^\w])", r"\\\1", d) for d in excluded if "/" not in d)
    return F.rlike(path, F.lit(rf"(?:\A|/)(?:{names})/")) if names else F.lit(False)


def matches_any(path: Column, patterns: list[str]) -> Column:
    """True when the path contains any of the substrings."""
    return F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(path, p))
