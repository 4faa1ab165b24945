"""Recommendations from a finished stack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions.text import severity_rank
from corpuslens.operators.conditions import checked
from corpuslens.operators.facts import lookup_table
from corpuslens.operators.running import running
from corpuslens.operators.validation import CATEGORIES
from corpuslens.rules import recommendations as r
from corpuslens.rules.conditions import ADVICE, FLAGS, Advice, Flag

COMPANION_CATEGORIES = ["frameworks", "frontend", "testing", "build_systems", "package_managers"]
_COLUMNS = ["repo_id", "text", "severity", "reason", "source", "part", "section_no", "place"]
# Parts in which recommendations of one severity follow each other.
_LED, _COMPANIONS, _CONFLICTS, _PRACTICES, _AI = range(5)


def rule_flags(stack: DataFrame, facts: DataFrame, flags: Sequence[Flag] = FLAGS) -> DataFrame:
    """One row per repository with everything the conditions of advice ask about."""
    held = checked(stack, [(f.name, f.condition) for f in flags])
    found = stack.groupBy("repo_id").agg(*[F.bool_or(c).alias(n) for n, c in held.items()]) if held else stack.select("repo_id").distinct()
    joined = facts.join(found, "repo_id", "left")
    return joined.select("repo_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in (*held, "has_git", "has_docs", "has_ci")])


def _rule_rows(flags: DataFrame, rules: Sequence[Advice]) -> DataFrame:
    """The advice whose condition holds, by kind and in the order of the rules."""
    held = checked(flags, [(a.name, a.condition) for a in rules])
    sources = {"conflict": ("compatibility_analysis", _CONFLICTS), "practice": ("best_practices", _PRACTICES)}
    entries = [
        F.when(
            held[a.name],
            F.struct(
                F.lit(a.text).alias("text"), F.lit(a.severity).alias("severity"), F.lit(a.reason).alias("reason"),
                F.lit(sources[a.kind][0]).alias("source"), F.lit(sources[a.kind][1]).alias("part"), F.lit(0).alias("section_no"), F.lit(i).cast("bigint").alias("place"),
            ),
        )
        for i, a in enumerate(rules)
    ]
    if not entries:
        return flags.sparkSession.createDataFrame([], "repo_id string, text string, severity string, reason string, source string, part int, section_no int, place bigint")
    return flags.select("repo_id", F.inline(F.array_compact(F.array(*entries))))


def companions(primary: DataFrame, stack: DataFrame) -> DataFrame:
    """Usual companions of a primary technology that the repository lacks."""
    rows = [
        (tech, name, severity, reason, i)
        for tech, entries in r.COMPANIONS.items()
        for i, (name, reason, severity) in enumerate(entries)
    ]
    table = lookup_table(primary, rows, "tech string, companion string, severity string, why string, nth int")
    present = stack.where(F.col("category").isin(COMPANION_CATEGORIES)).select("repo_id", F.col("tech").alias("companion"))
    nth_category = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("int")
    return (
        primary.join(table, "tech")
        .join(present, ["repo_id", "companion"], "left_anti")
        .select(
            "repo_id",
            F.concat(F.lit("Consider adding "), "companion", F.lit(" to your project, which is commonly used with "), "tech").alias("text"),
            "severity",
            F.concat("why", F.lit(" for "), "tech").alias("reason"),
            F.lit("stack_analysis").alias("source"),
            F.lit(_COMPANIONS).alias("part"), nth_category.alias("section_no"), F.col("nth").cast("bigint").alias("place"),
        )
    )


def _ordered(rows: DataFrame, bounded: bool) -> DataFrame:
    """Most severe first, then in rule order; ``nth`` is the position within the repository.

    Rule rows are few per repository and ranked in a window; rows of answers (not ``bounded``) over ranges of rows.
    """
    columns = ["repo_id", "nth", "text", "severity", "reason", "source"]
    order = [severity_rank(F.col("severity")), "part", "section_no", "place", "text"]
    if bounded:
        return rows.withColumn("nth", F.row_number().over(W.partitionBy("repo_id").orderBy(*order))).select(columns)
    ranked = running(rows, ["repo_id"], [*order, "reason", "source"], position="nth")
    return ranked.withColumn("nth", F.col("nth").cast("int")).select(columns)


def recommendations(
    stack: DataFrame, primary: DataFrame, facts: DataFrame, ai: DataFrame | None = None, flags: Sequence[Flag] = FLAGS, advice: Sequence[Advice] = ADVICE,
) -> DataFrame:
    """Companions, conflicts and best practices; ``ai`` rows (repo_id, ord, text, severity, reason)
    join them unless their text, in any case, is already there.  ``flags`` and ``advice`` are rows with conditions."""
    rows = companions(primary, stack).select(_COLUMNS).unionByName(_rule_rows(rule_flags(stack, facts, flags), advice))
    if ai is not None:
        fresh = ai.withColumn("key", F.lower("text")).join(
            rows.select("repo_id", F.lower("text").alias("key")), ["repo_id", "key"], "left_anti"
        )
        first = fresh.groupBy("repo_id", "key").agg(F.min(F.struct("ord", "text", "severity", "reason")).alias("f"))
        rows = rows.unionByName(
            first.select(
                "repo_id", "f.text", "f.severity", "f.reason", F.lit("ai_analysis").alias("source"),
                F.lit(_AI).alias("part"), F.lit(0).alias("section_no"), F.col("f.ord").cast("bigint").alias("place"),
            )
        )
    return _ordered(rows, bounded=ai is None)


def review_recommendations(
    suggestions: DataFrame, stack: DataFrame, primary: DataFrame, facts: DataFrame, flags: Sequence[Flag] = FLAGS, advice: Sequence[Advice] = ADVICE,
) -> DataFrame:
    """Variant led by review suggestions (repo_id, section, ord, text, severity, reason).

    Suggestions with the same text count once; rule texts follow, all companions as medium.
    """
    sections = F.array(*[F.lit(s) for s in ("technologies", "architecture", "code_quality")])
    section_no = F.array_position(sections, F.col("section")).cast("int")
    first = suggestions.where(section_no > 0).groupBy("repo_id", "text").agg(
        F.min(F.struct(section_no.alias("no"), "ord", "section", "severity", "reason")).alias("f")
    )
    led = first.select(
        "repo_id", "text", "f.severity", F.coalesce("f.reason", F.lit("AI-detected suggestion")).alias("reason"),
        F.col("f.section").alias("source"), F.lit(_LED).alias("part"), F.col("f.no").alias("section_no"), F.col("f.ord").cast("bigint").alias("place"),
    )
    rows = [(tech, name, i) for tech, names in r.FRAMEWORK_COMPANIONS.items() for i, name in enumerate(names)]
    table = lookup_table(primary, rows, "tech string, companion string, nth int")
    present = stack.where(F.col("category").isin(COMPANION_CATEGORIES)).select("repo_id", F.col("tech").alias("companion"))
    missing = (
        primary.where("category = 'frameworks'").join(table, "tech").join(present, ["repo_id", "companion"], "left_anti")
        .select(
            "repo_id",
            F.concat(F.lit("Consider adding "), "companion", F.lit(" to your project, which is commonly used with "), "tech").alias("text"),
            F.lit("medium").alias("severity"),
            F.concat(F.lit("Common companion technology for "), "tech").alias("reason"),
            F.lit("stack_analysis").alias("source"),
            F.lit(_COMPANIONS).alias("part"), F.lit(0).alias("section_no"), F.col("nth").cast("bigint").alias("place"),
        )
    )
    rules = _rule_rows(rule_flags(stack, facts, flags), [a for a in advice if a.in_review])
    return _ordered(led.unionByName(missing).unionByName(rules), bounded=False)
