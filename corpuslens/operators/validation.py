"""Cross-validation of the categories of one repository, and the choice of primary technologies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.rules import validation

CATEGORIES = [
    "languages", "frameworks", "databases", "build_systems", "package_managers", "frontend", "devops",
    "architecture", "testing",
]
MIN_CONFIDENCE = 15


def _list_map(table: dict[str, list[str]]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,array<string>>")


def _ranked_names(details: Column) -> Column:
    """Technologies by confidence, then matches, then name."""
    order = F.transform(
        F.map_entries(details),
        lambda e: F.struct((-e["value"]["confidence"]).alias("c"), (-e["value"]["matches"]).alias("m"), e["key"].alias("k")),
    )
    return F.transform(F.array_sort(order), lambda o: o["k"])


def primary_languages(languages: Column) -> Column:
    """Languages with at least half the confidence of the leading one, strongest first."""
    best = F.array_max(F.transform(F.map_values(languages), lambda v: v["confidence"]))
    return _ranked_names(F.map_filter(languages, lambda _, v: v["confidence"] >= best * 0.5))


def _compatible(details: Column, table: dict[str, list[str]], leading: Column) -> Column:
    """Halve or drop what no leading language goes with; leave high confidence alone."""
    lookup = _list_map(table)
    none = F.array().cast("array<string>")
    allowed = F.flatten(F.transform(leading, lambda l: F.coalesce(F.try_element_at(lookup, l), none)))

    def foreign(k, v):
        return (F.size(leading) > 0) & ~F.array_contains(allowed, k) & (v["confidence"] < 80)

    kept = F.map_filter(details, lambda k, v: ~(foreign(k, v) & (v["confidence"] <= 40)))
    return F.transform_values(
        kept,
        lambda k, v: F.struct(
            v["matches"].alias("matches"),
            F.when(foreign(k, v), v["confidence"] / 2).otherwise(v["confidence"]).alias("confidence"),
            F.when(foreign(k, v), F.lit(True)).otherwise(F.lit(False)).alias("remark"),
        ),
    )


def _plain(details: Column) -> Column:
    return F.transform_values(
        details, lambda _, v: F.struct(v["matches"].alias("matches"), v["confidence"].alias("confidence"), F.lit(False).alias("remark"))
    )


def cross_validated(row: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Check frameworks and tools against languages, lift matching databases, apply the floor.

    ``remark`` marks entries whose evidence gets a warning or a note; ``leading_languages`` and
    ``leading_framework`` name what the note is about.
    """
    present = [c for c in CATEGORIES if c in row.columns]
    row = row.withColumns({
        "leading_languages": primary_languages(F.col("languages")),
        "leading_framework": F.get(_ranked_names(F.col("frameworks")), F.lit(0)),
    })
    fitting = F.coalesce(
        F.try_element_at(_list_map(validation.FRAMEWORK_DATABASES), F.col("leading_framework")),
        F.array().cast("array<string>"),
    )
    tables = {
        "frameworks": validation.LANGUAGE_FRAMEWORKS,
        "build_systems": validation.LANGUAGE_BUILD_TOOLS,
        "package_managers": validation.LANGUAGE_BUILD_TOOLS,
    }
    checked = {}
    for category in present:
        details = F.col(category)
        if category in tables:
            changed = _compatible(details, tables[category], F.col("leading_languages"))
        elif category == "databases":
            changed = F.transform_values(
                details,
                lambda k, v: F.struct(
                    v["matches"].alias("matches"),
                    F.when(F.array_contains(fitting, k), F.least(F.lit(100.0), v["confidence"] * 1.2))
                    .otherwise(v["confidence"])
                    .alias("confidence"),
                    F.array_contains(fitting, k).alias("remark"),
                ),
            )
        else:
            changed = _plain(details)
        checked[category] = F.map_filter(changed, lambda _, v: v["confidence"] >= minimum)
    return row.withColumns(checked)


def remark_text(category: str, languages: Column, framework: Column) -> Column:
    if category == "databases":
        return F.concat(F.lit("Compatible with detected framework: "), framework)
    subject = {"frameworks": "Framework", "build_systems": "Build system"}.get(category, "Package manager")
    return F.concat(
        F.lit(f"Warning: {subject} may not be compatible with detected languages: "), F.array_join(languages, ", ")
    )


def top_per_category(stack: DataFrame, count: int) -> DataFrame:
    """The ``count`` strongest technologies of each category of each repository."""
    order = W.partitionBy("repo_id", "category").orderBy(F.desc("confidence"), F.desc("matches"), "tech")
    return stack.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def primary_technologies(stack: DataFrame) -> DataFrame:
    return top_per_category(stack, 1).select("repo_id", "category", "tech")


def filter_stack(
    stack: DataFrame, min_confidence: float, categories: list[str] | None = None, passed: list[str] | None = None
) -> DataFrame:
    """Rows of a finished stack by confidence and category; primary technologies stay as they were.

    Rows of the categories in ``passed``, such as answers of a language model, stay whatever they hold.
    """
    kept = F.col("confidence") >= min_confidence
    if categories:
        kept = kept & F.col("category").isin(categories)
    return stack.where(kept | F.col("category").isin(passed)) if passed else stack.where(kept)
