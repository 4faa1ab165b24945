"""The analysis of a corpus: files in, technology stacks out, every repository at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.functions.numbers import exact_round
from corpuslens.operators import detectors as d
from corpuslens.operators import evidence
from corpuslens.operators import content_facts, facts, scan, scores, validation
from corpuslens.rules.ruleset import RuleSet, default_rules
from corpuslens.session import materialize

DETECTORS = [c for c in validation.CATEGORIES if c != "languages"]
# Detectors whose corrections read the scores of another one.
_PAIRED = {"build_systems": "package_managers", "package_managers": "build_systems"}
_PARTS = {"databases": ["databases+extra"], "architecture": ["architecture+directory", "architecture+file"]}


def detector_hits(files: DataFrame, rules: RuleSet, wanted: list[str], copies: bool | None = None) -> DataFrame:
    """All hits of the wanted detectors as narrow rows."""
    parts = []
    if rules.path_rules:
        parts.append(scan.path_hits(files, rules))
    parts.append(scan.content_hits(files, rules, content_facts.wanted_facts(wanted), copies))
    return reduce(DataFrame.unionByName, parts)


def _language_rows(files: DataFrame) -> DataFrame:
    counts = facts.language_counts(files)
    return counts.groupBy("repo_id").agg(
        F.map_from_entries(F.collect_list(F.struct("tech", "points"))).alias("languages")
    )


def _evaluated(files: DataFrame, rules: RuleSet, wanted: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """What scores come from: hits to sum, manifest hits, files or their groups, and all hits if they were written.

    Where contents repeat, rules are evaluated per group of equal files (``scan.file_groups``), else per file.
    """
    groups = materialize(scan.file_groups(files, rules), "groups")
    if scan.groups_pay(groups):
        sums, manifests = scan.grouped_hits(files, groups, rules, content_facts.wanted_facts(wanted))
        return sums, manifests, groups, None
    hits = materialize(detector_hits(files, rules, wanted, copies=False), "hits")
    return hits, hits, files, hits


def score_state(files: DataFrame, hits: DataFrame, wanted: list[str], manifests: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """One row per repository with raw score maps, flags and everything corrections look at.

    ``groups`` may stand for the files where only counts matter, ``manifests`` holds the manifest hits if ``hits`` are sums.
    """
    groups, manifests = files if groups is None else groups, hits if manifests is None else manifests
    columns = [c for w in wanted for c in [w, *_PARTS.get(w, [])]] + ["source_language", "count"]
    state = scores.score_rows(scores.tallies(hits), columns)
    base = groups.groupBy("repo_id").agg(F.lit(1).alias("known")).drop("known")
    state = base.join(state, "repo_id", "left")
    if "package_managers" in wanted:
        state = state.join(facts.first_manifests(manifests), "repo_id", "left")
    if "architecture" in wanted:
        state = (
            state.join(facts.component_counts(groups), "repo_id", "left")
            .join(facts.service_directories(files), "repo_id", "left")
            .join(facts.feature_modules(files), "repo_id", "left")
        )
    if "testing" in wanted:
        covered = facts.test_source_ratio(groups).groupBy("repo_id").agg(F.count("*").alias("covered_extensions"))
        state = state.join(covered, "repo_id", "left")
    return _with_shapes(_without_nulls(state))


def _with_shapes(state: DataFrame) -> DataFrame:
    """Columns for the facts that the content pass left in the flags and counts."""
    languages = F.col("source_language")
    total = F.aggregate(F.map_values(languages), F.lit(0.0), lambda a, v: a + v)
    dominant = F.map_keys(F.map_filter(languages, lambda _, v: v > total * 0.1))
    declared = F.coalesce(scores.score(F.col("count"), "pip_declarations"), F.lit(0.0))
    shapes = {name: F.array_contains("flags", f"fact:{name}") for name in content_facts.SHAPE_FLAGS}
    return state.withColumns({"dominant": dominant, "pip_declarations": declared, **shapes}).drop("source_language", "count")


def _without_nulls(state: DataFrame) -> DataFrame:
    """Empty maps, lists, zero counts and false flags for repositories without the fact."""
    filled = []
    for field in state.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if field.name in ("repo_id", "modules", "first_names"):
            filled.append(column)
            continue
        if kind.startswith("map"):
            column = F.coalesce(column, F.map_from_entries(F.array().cast(f"array<struct<k:string,v:{kind[11:-1]}>>")))
        elif kind.startswith("array"):
            column = F.coalesce(column, F.array().cast(kind))
        elif kind == "boolean":
            column = F.coalesce(column, F.lit(False))
        elif kind == "bigint":
            column = F.coalesce(column, F.lit(0))
        filled.append(column.alias(field.name))
    return state.select(*filled)


def detect(files: DataFrame, wanted: list[str], rules: RuleSet | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Detected technologies per repository row, before cross-validation."""
    needed = list(dict.fromkeys([*wanted, *(_PAIRED[w] for w in wanted if w in _PAIRED)]))
    rules = (rules or default_rules()).for_detectors(needed)
    if hits is not None:
        return d.detected(score_state(files, hits, needed), needed, rules.corrections)
    hits, manifests, groups, _ = _evaluated(files, rules, needed)
    return d.detected(score_state(files, hits, needed, manifests, groups), needed, rules.corrections)


def _entries(category: str, *more) -> Column:
    """The map of a category as an array of row structs; ``more`` are functions of an entry."""

    def entry(e):
        return F.struct(
            F.lit(category).alias("category"),
            e["key"].alias("tech"),
            e["value"]["matches"].alias("matches"),
            e["value"]["confidence"].alias("confidence"),
            _sub_category(category, e["key"]).alias("sub_category"),
            *[f(category, e) for f in more],
        )

    return F.transform(F.map_entries(F.col(category)), entry)


def detection_rows(row: DataFrame, wanted: list[str]) -> DataFrame:
    """The maps of a repository row as long rows."""
    return row.select("repo_id", F.inline(F.concat(*[_entries(c) for c in wanted])))


def _sub_category(category: str, tech):
    if category not in scores.CATEGORISED:
        return F.lit(None).cast("string")
    return d.sub_category(category, F.try_element_at(F.col(f"{category}_category"), tech))


def detect_rows(files: DataFrame, detector: str, rules: RuleSet | None = None) -> DataFrame:
    """Rows (repo_id, category, tech, matches, confidence, sub_category) of one detector."""
    return detection_rows(detect(files, [detector], rules), [detector])


def detect_languages(files: DataFrame) -> DataFrame:
    """Languages with weighted file count, share of the total and confidence."""
    counts = facts.language_counts(files)
    share = F.col("points") / F.sum("points").over(W.partitionBy("repo_id")) * 100
    return counts.select(
        "repo_id",
        "tech",
        F.col("points").alias("matches"),
        exact_round(share, 2).alias("percentage"),
        exact_round(F.least(F.lit(100.0), share * 2), 2).alias("confidence"),
    )


@dataclass
class Analysis:
    """Results of one analysis; what an attribute needs is computed when it is first asked for."""

    files: DataFrame
    rules: RuleSet
    min_confidence: float

    @cached_property
    def _evaluation(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
        return _evaluated(self.files, self.rules, DETECTORS)

    @cached_property
    def rows(self) -> DataFrame:
        """One row per repository with a map per detector, cross-validated."""
        sums, manifests, groups, _ = self._evaluation
        state = score_state(self.files, sums, DETECTORS, manifests, groups).join(_language_rows(groups), "repo_id", "left")
        row = d.detected(_without_nulls(materialize(state, "scores")), DETECTORS, self.rules.corrections)
        row = row.withColumn("languages", d.languages_from_counts(F.col("languages")))
        return validation.cross_validated(row, self.min_confidence)

    @cached_property
    def hits(self) -> DataFrame:
        """All hits of all files with their evidence."""
        written = self._evaluation[-1]
        return materialize(detector_hits(self.files, self.rules, DETECTORS), "hits") if written is None else written

    @cached_property
    def scored(self) -> DataFrame:
        """(repo_id, category, tech, matches, confidence, sub_category) without evidence."""

        def remark(category, entry):
            text = validation.remark_text(category, F.col("leading_languages"), F.col("leading_framework"))
            return F.when(entry["value"]["remark"], text).alias("remark")

        details = [_entries(c, remark) for c in validation.CATEGORIES]
        return self.rows.select("repo_id", F.inline(F.concat(*details)))

    @cached_property
    def stack(self) -> DataFrame:
        """The long stack with up to five evidence strings, then warnings and notes."""
        evidence = scores.top_evidence(self._evidence_hits()).withColumnRenamed("detector", "category")
        none = F.array().cast("array<string>")
        joined = self.scored.join(evidence, ["repo_id", "category", "tech"], "left")
        remark = F.when(F.col("remark").isNotNull(), F.array("remark")).otherwise(none)
        return joined.select(
            "repo_id", "category", "tech", "matches", "confidence", "sub_category",
            F.when(F.col("category") == "languages", F.lit(None))
            .otherwise(F.concat(F.coalesce("evidence", none), remark))
            .alias("evidence"),
        )

    @cached_property
    def primary(self) -> DataFrame:
        return validation.primary_technologies(self.scored)

    @cached_property
    def meta(self) -> DataFrame:
        """File counts per repository and the time of the analysis."""
        return facts.repository_facts(self.files).select(
            "repo_id", "file_count", "content_count", F.current_timestamp().alias("analyzed_at")
        )

    def _evidence_hits(self) -> DataFrame:
        connection_rules: dict[str, tuple[int, str]] = {}
        for rule in self.rules.content_rules:
            if rule.tech.startswith("connection:"):
                connection_rules.setdefault(rule.tech, (rule.ordinal, rule.pattern))
        return self.hits.unionByName(evidence.derived(self.files, self.hits, self.rows, connection_rules))


def analyze(files: DataFrame, rules: RuleSet | None = None, min_confidence: float = validation.MIN_CONFIDENCE) -> Analysis:
    """Analyse a corpus of ``(repo_id, path, size, content)`` rows.

    Nothing is read before a result is asked for.  Then files are grouped or scanned once, which gives the score
    rows, one per repository; these are written to the shared folder.  The scores, the primary technologies and
    all that follows read them and never the contents again.  Only the evidence of ``stack`` needs the hits of
    every file, and ``meta`` counts files alone.
    """
    return Analysis(files, rules or default_rules(), min_confidence)
