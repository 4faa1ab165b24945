"""Chunks and prompts for language-model review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.numbers import one_decimal

CHUNK_TOKENS = 1500
OVERLAP_LINES = 200
_FILE = "File {filename} ({language}) follows.\n\n```\n{code}\n```\n\n"
_ADVICE = '"suggestions": [{"text": "...", "severity": "high, medium or low", "reason": "..."}]'
#: One prompt per kind of answer; each names the fields that ``answers.SCHEMAS`` reads.
TEMPLATES = {
    "technologies": _FILE + (
        "Which frameworks, databases, libraries and tools does it use? Answer with JSON only, of this shape:\n"
        '{"technologies": [{"name": "...", "category": "framework, database, frontend, build_system, package_manager or library", '
        '"confidence": 0 to 100, "evidence": ["lines that show it"]}], ' + _ADVICE + "}"
    ),
    "architecture": _FILE + (
        "Which architectural and design patterns does it follow? Answer with JSON only, of this shape:\n"
        '{"patterns": [{"name": "...", "type": "architecture or design", "confidence": 0 to 100, "evidence": ["what shows it"]}], ' + _ADVICE + "}"
    ),
    "code_quality": _FILE + (
        "How readable, maintainable and fast is it? Answer with JSON only, of this shape:\n"
        '{"quality_assessment": {"readability": {"score": 0 to 100, "strengths": ["..."], "weaknesses": ["..."]}, '
        '"maintainability": {...}, "performance": {...}}, '
        '"issues": [{"type": "...", "severity": "high, medium or low", "description": "...", "location": "..."}], ' + _ADVICE + "}"
    ),
}
REVIEW_TEMPLATE = TEMPLATES["technologies"]


def token_chunks(texts: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Lines of each text with their running token count and chunk number.

    ``texts`` has ``text_id`` and ``text``.  A line belongs to the chunk its running total before it
    falls in.  Totals run within a row, so that no text is shuffled.
    """


    @F.pandas_udf("array<struct<line_no:int,line:string,tokens:int,running:bigint>>")
    def counted(column: pd.Series) -> pd.Series:
        def rows(text):
            running, found = 0, []
            for at, line in enumerate(text.split("\n")):
                running += len(line) // 4
                found.append({"line_no": at, "line": line, "tokens": len(line) // 4, "running": running})
            return found

        return column.map(rows, na_action="ignore")

    lines = texts.select("text_id", F.inline(counted("text")))
    return lines.withColumn("chunk_no", F.floor((F.col("running") - F.col("tokens")) / chunk_tokens))


def chunk_texts(lines: DataFrame, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Text of each chunk, led by the last ``overlap`` lines of the chunk before it."""
    parts = lines.groupBy("text_id", "chunk_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]).alias("lines")
    )
    tails = parts.select(
        "text_id", (F.col("chunk_no") + 1).alias("chunk_no"),
        F.slice("lines", F.greatest(F.size("lines") - overlap + 1, F.lit(1)), overlap).alias("tail"),
    )
    none = F.array().cast("array<string>")
    return parts.join(tails, ["text_id", "chunk_no"], "left").select(
        "text_id", "chunk_no", F.array_join(F.concat(F.coalesce("tail", none), "lines"), "\n").alias("chunk")
    )


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots of a template, leaving every other brace alone.

    The template is cut at its slots first, so braces inside the values are never taken for slots.
    """
    import re

    parts = re.split("(" + "|".join(re.escape("{" + n + "}") for n in values) + ")", template)
    return F.concat(*[values[p[1:-1]] if p[1:-1] in values and p.startswith("{") else F.lit(p) for p in parts if p])


def review_prompts(files: DataFrame, template: str = REVIEW_TEMPLATE) -> DataFrame:
    """Prompt per file with a known language; needs ``path``, ``language`` and ``content``."""
    name = F.substring_index("path", "/", -1)
    return files.where("content is not null and language <> 'unknown'").select(
        "repo_id", "path",
        render(template, filename=name, language=F.col("language"), code=F.col("content")).alias("prompt"),
    )


def findings_text(findings: DataFrame, kind: str, empty: str) -> DataFrame:
    """Findings of a repository as lines, most confident first."""
    entry = F.struct((-F.col("confidence")).alias("o"), "name", F.col(kind).alias("kind"), "confidence")
    line = lambda s: F.concat(
        F.lit("- "), F.coalesce(s["name"], F.lit("Unknown")), F.lit(" ("), F.coalesce(s["kind"], F.lit("Unknown")), F.lit(", "),
        one_decimal(s["confidence"]), F.lit("% confidence)"),
    )
    lines = F.transform(F.array_sort(F.collect_list(entry)), line)
    return findings.groupBy("repo_id").agg(F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(empty).alias("text"))


def quality_text(quality: DataFrame) -> DataFrame:
    """Scores, then up to three strengths and weaknesses per aspect."""
    from corpuslens.operators.answers import ASPECTS

    no = F.array_position(F.array(*[F.lit(a) for a in ASPECTS]), F.col("aspect"))
    ordered = F.array_sort(F.collect_list(F.struct(no.alias("no"), "aspect", "score", "strengths", "weaknesses")))
    score = lambda s: F.concat(F.initcap(s["aspect"]), F.lit(": "), one_decimal(s["score"]), F.lit("/100"))

    def points(s, kind):
        lines = F.transform(F.slice(s[kind], 1, 3), lambda p: F.concat(F.lit("- "), p))
        head = F.concat(F.lit("\n"), F.initcap(s["aspect"]), F.lit(f" {kind}:"))
        return F.when(F.size(s[kind]) > 0, F.concat(F.array(head), lines)).otherwise(F.array().cast("array<string>"))

    gathered = quality.groupBy("repo_id").agg(ordered.alias("q"))
    return gathered.select(
        "repo_id",
        F.array_join(
            F.concat(
                F.transform("q", score),
                F.flatten(F.transform("q", lambda s: F.concat(points(s, "strengths"), points(s, "weaknesses")))),
            ),
            "\n",
        ).alias("text"),
    )


def repository_text(meta: DataFrame) -> DataFrame:
    return meta.select(
        "repo_id",
        F.concat(F.lit("Repository path: "), "repo_id", F.lit("\nFile count: "), F.col("file_count").cast("string")).alias("text"),
    )


def stack_summary(stack: DataFrame, primary: DataFrame, per_category: int = 3) -> DataFrame:
    """JSON of the primary technologies and the strongest of each category, one row per repository."""
    from corpuslens.operators.validation import top_per_category

    lists = (
        top_per_category(stack, per_category)
        .groupBy("repo_id", "category")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tech"))), lambda s: s["tech"]).alias("techs"))
        .groupBy("repo_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "techs")))).alias("technologies"))
    )
    chosen = primary.groupBy("repo_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "tech")))).alias("primary_technologies")
    )
    return lists.join(chosen, "repo_id").select("repo_id", F.to_json(F.struct("primary_technologies", "technologies")).alias("summary"))
