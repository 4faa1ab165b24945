"""Reports: one text per repository.  Every group holds one repository's stack, a few hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.numbers import one_decimal
from corpuslens.functions.text import title_case
from corpuslens.operators.validation import CATEGORIES


def _category_no(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category)


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _primary_lines(primary: DataFrame, before: str, after: str) -> DataFrame:
    line = F.concat(F.lit(before), title_case(F.col("category")), F.lit(after), "tech")
    entries = F.collect_list(F.struct(_category_no(F.col("category")).alias("no"), line.alias("line")))
    return primary.groupBy("repo_id").agg(F.transform(F.sort_array(entries), lambda s: s["line"]).alias("primary_lines"))


def _sections(stack: DataFrame, head, line) -> DataFrame:
    """Per repository the sections of its categories, strongest technology first."""
    evidence = F.coalesce("evidence", _nothing())
    entry = F.struct((-F.col("confidence")).alias("c"), (-F.col("matches")).alias("m"), "tech", "confidence", evidence.alias("evidence"))
    sections = stack.groupBy("repo_id", "category").agg(F.array_sort(F.collect_list(entry)).alias("techs")).select(
        "repo_id", _category_no(F.col("category")).alias("no"),
        F.concat(head(title_case(F.col("category"))), F.transform("techs", line), F.array(F.lit(""))).alias("lines"),
    )
    return sections.groupBy("repo_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "lines"))), lambda s: s["lines"])).alias("sections")
    )


def _assemble(meta: DataFrame, primary: DataFrame, sections: DataFrame, build) -> DataFrame:
    joined = meta.join(primary, "repo_id", "left").join(sections, "repo_id", "left")
    return joined.select("repo_id", F.array_join(build(), "\n").alias("report"))


def _meta_lines(prefix: str, suffix: str) -> Column:
    files = F.col("file_count").cast("string")
    return F.array(
        F.concat(F.lit(f"{prefix}Repository:{suffix} "), "repo_id"),
        F.concat(F.lit(f"{prefix}Files analyzed:{suffix} "), files),
        F.concat(F.lit(f"{prefix}Analyzed at:{suffix} "), F.col("analyzed_at").cast("string")),
        F.lit(""),
    )


def markdown_report(stack: DataFrame, primary: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata, primary technologies and a table per category with up to three pieces of evidence."""

    def head(title):
        return F.array(
            F.concat(F.lit("## "), title), F.lit(""), F.lit("| Technology | Confidence | Evidence |"),
            F.lit("|------------|------------|----------|"),
        )

    def line(t):
        return F.concat(
            F.lit("| "), t["tech"], F.lit(" | "), one_decimal(t["confidence"]), F.lit("% | "),
            F.array_join(F.slice(t["evidence"], 1, 3), "<br>"), F.lit(" |"),
        )

    def build():
        chosen = F.when(
            F.col("primary_lines").isNotNull(),
            F.concat(F.array(F.lit("## Primary Technologies"), F.lit("")), "primary_lines", F.array(F.lit(""))),
        )
        top = F.array(F.lit("# Repository Analysis Report"), F.lit(""), F.lit("## Metadata"), F.lit(""))
        return F.concat(top, _meta_lines("- **", "**"), F.coalesce(chosen, _nothing()), F.coalesce("sections", _nothing()))

    return _assemble(meta, _primary_lines(primary, "- **", ":** "), _sections(stack, head, line), build)


def text_report(stack: DataFrame, primary: DataFrame, meta: DataFrame) -> DataFrame:
    """The same as plain text, without evidence."""
    stack = stack if "evidence" in stack.columns else stack.withColumn("evidence", _nothing())
    head = lambda title: F.array(F.concat(title, F.lit(":")))
    line = lambda t: F.concat(F.lit("  - "), t["tech"], F.lit(" ("), one_decimal(t["confidence"]), F.lit("%)"))

    def build():
        chosen = F.when(
            F.col("primary_lines").isNotNull(),
            F.concat(F.array(F.lit("Primary Technologies:")), "primary_lines", F.array(F.lit(""))),
        )
        top = F.array(F.lit("===== REPOSITORY ANALYSIS REPORT ====="), F.lit(""))
        end = F.array(F.lit("=========================================="))
        return F.concat(top, _meta_lines("", ""), F.coalesce(chosen, _nothing()), F.coalesce("sections", _nothing()), end)

    return _assemble(meta, _primary_lines(primary, "  - ", ": "), _sections(stack, head, line), build)


def review_report(
    technologies: DataFrame, patterns: DataFrame, quality: DataFrame, issues: DataFrame, recommendations: DataFrame
) -> DataFrame:
    """Text section on language-model findings: ten technologies, five patterns, scores, five issues,
    seven recommendations and how many more there are."""

    def gathered(rows: DataFrame, name: str, order: Column, line: Column, limit: int | None, title: str, more=False) -> DataFrame:
        entries = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))), lambda s: s["line"])
        agg = rows.groupBy("repo_id").agg(entries.alias("all_lines"))
        shown = F.slice("all_lines", 1, limit) if limit else F.col("all_lines")
        parts = [F.array(F.lit(title)), shown]
        if more:
            left = F.size("all_lines") - limit
            parts.append(F.when(left > 0, F.array(F.concat(F.lit("  (+ "), left.cast("string"), F.lit(" more recommendations)")))).otherwise(_nothing()))
        return agg.select("repo_id", F.concat(*parts, F.array(F.lit(""))).alias(name))

    def finding(kind: str) -> Column:
        return F.concat(F.lit("  - "), "name", F.lit(" ("), F.col(kind), F.lit(", "), one_decimal(F.col("confidence")), F.lit("% confidence)"))

    def marked(text: str) -> Column:
        return F.concat(F.lit("  - ["), F.upper("severity"), F.lit("] "), F.col(text))

    confident = F.struct(-F.col("confidence"), "name")
    aspect_no = F.array_position(F.array(F.lit("readability"), F.lit("maintainability"), F.lit("performance")), F.col("aspect"))
    score = F.concat(F.lit("  - "), F.initcap("aspect"), F.lit(": "), one_decimal(F.col("score")), F.lit("/100"))
    parts = {
        "t": gathered(technologies, "t", confident, finding("category"), 10, "Technologies Detected by AI:"),
        "p": gathered(patterns, "p", confident, finding("type"), 5, "Architecture Patterns Detected by AI:"),
        "q": gathered(quality, "q", aspect_no, score, None, "Code Quality Assessment:"),
        "i": gathered(issues, "i", F.col("nth"), marked("description"), 5, "Top Code Issues:"),
        "r": gathered(recommendations, "r", F.col("nth"), marked("text"), 7, "AI Recommendations:", more=True),
    }
    joined = None
    for part in parts.values():
        joined = part if joined is None else joined.join(part, "repo_id", "full")
    lines = F.concat(F.array(F.lit("===== AI-ENHANCED ANALYSIS ====="), F.lit("")), *[F.coalesce(n, _nothing()) for n in parts])
    return joined.select("repo_id", F.array_join(lines, "\n").alias("report"))


def stack_documents(stack: DataFrame, primary: DataFrame, meta: DataFrame) -> DataFrame:
    """One JSON document per repository: category -> technology -> details, primary, metadata."""
    fields = [c for c in ("matches", "confidence", "sub_category", "evidence") if c in stack.columns]
    by_category = stack.groupBy("repo_id", "category").agg(
        F.map_from_entries(F.collect_list(F.struct("tech", F.struct(*fields).alias("details")))).alias("techs")
    )
    stacks = by_category.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "techs"))).alias("stack"))
    chosen = primary.groupBy("repo_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "tech")))).alias("primary_technologies")
    )
    details = F.struct(*[c for c in meta.columns if c != "repo_id"]).alias("metadata")
    return meta.join(stacks, "repo_id", "left").join(chosen, "repo_id", "left").select(
        "repo_id", F.to_json(F.struct("repo_id", "stack", "primary_technologies", details)).alias("document")
    )
