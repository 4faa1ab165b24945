"""Corrections of each detector, as expressions over a repository's score row.

Every function takes the score row (see ``scores.score_rows``) and returns the corrected map of one
detector.  The order of the steps matters: later ones read the results of earlier ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.numbers import exact_round
from corpuslens.operators.conditions import checked
from corpuslens.operators.scores import (
    add_all,
    divide_unless,
    divided,
    normalised,
    score,
    scored,
    with_score,
)
from corpuslens.rules import architecture, build, databases, frameworks, frontend, devops, testing
from corpuslens.rules.conditions import CORRECTIONS, Correction

THRESHOLDS = {
    "frameworks": ({"SQLAlchemy": 20}, 35),
    "databases": ({}, 35),
    "build_systems": ({}, 35),
    "package_managers": ({"npm": 25}, 35),
    "frontend": ({}, 35),
    "devops": ({}, 40),
    "architecture": ({}, 35),
    "testing": ({}, 40),
}


def flagged(name: str) -> Column:
    return F.array_contains("flags", name)


def _text_list(values) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _text_map(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def corrected(row: DataFrame, detectors: list[str], corrections: Sequence[Correction] = CORRECTIONS) -> DataFrame:
    """Replace the raw maps of detectors by their corrected ones.

    A step names the columns it replaces; steps of different detectors touch different columns, so
    the nth steps of all detectors share one projection.  Where a list of steps has a number, the
    corrections of that stage follow each other.
    """
    wanted = [c for c in corrections if c.detector in detectors]
    held = checked(row, [(f"{i} {c.detector} {c.tech}", c.condition) for i, c in enumerate(wanted)])
    rules = [(c, held[f"{i} {c.detector} {c.tech}"]) for i, c in enumerate(wanted)]
    steps = {
        d: [s for entry in STEPS[d] for s in (_correction_steps(rules, d, entry) if isinstance(entry, int) else [entry])] for d in detectors
    }
    for nth in range(max(map(len, steps.values()))):
        changes: dict[str, Column] = {}
        for detector in detectors:
            if nth < len(steps[detector]):
                changes.update(steps[detector][nth]())
        row = row.withColumns(changes)
    return row


def _correction_steps(rules: list[tuple[Correction, Column]], detector: str, stage: int) -> list:
    """A step per correction of a stage."""

    def change(rule: Correction, holds: Column):
        if rule.divisor:
            return lambda m: divide_unless(m, rule.tech, holds, rule.divisor)
        return lambda m: F.transform_values(m, lambda k, v: F.when((k == rule.tech) & ~holds, F.lit(0.0)).otherwise(v))

    return [_update(detector, change(c, holds)) for c, holds in rules if c.detector == detector and c.stage == stage]


def _update(column: str, change):
    return lambda: {column: change(F.col(column))}


# Frameworks.


def _foreign_language() -> dict[str, Column]:
    needed = _text_map(frameworks.REQUIRED_LANGUAGE)

    def change(k, v):
        language = F.try_element_at(needed, k)
        foreign = language.isNotNull() & ~F.array_contains("dominant", language)
        return F.when(foreign, divided(v, 5)).otherwise(v)

    return {"frameworks": F.transform_values("frameworks", change)}


def _unproven() -> dict[str, Column]:
    provable = _text_list(frameworks.STRONG_EVIDENCE)

    def change(k, v):
        proven = F.array_contains("flags", F.concat(F.lit("strong:"), k))
        return F.when(F.array_contains(provable, k) & ~proven, divided(v, 3)).otherwise(v)

    return {"frameworks": F.transform_values("frameworks", change)}


def _sqlalchemy_with_flask(scores: Column) -> Column:
    flask, own = score(scores, "Flask"), score(scores, "SQLAlchemy")
    share = F.when(flagged("flask_sqlalchemy"), F.greatest(flask * 0.8, flask * 0.9)).otherwise(flask * 0.8)
    both = flask.isNotNull() & own.isNotNull()
    return F.when(both, with_score(scores, "SQLAlchemy", F.greatest(own, share))).otherwise(scores)


FRAMEWORK_STEPS = [
    _foreign_language,
    _unproven,
    1,
    _update("frameworks", _sqlalchemy_with_flask),
]


# Databases.


def _without_connection(scores: Column) -> Column:
    known = _text_list(databases.CONNECTIONS)

    def change(k, v):
        connected = F.array_contains("flags", F.concat(F.lit("connection:"), k))
        return F.when(F.array_contains(known, k) & ~connected, divided(v, 2)).otherwise(v)

    return F.transform_values(scores, change)


def _generic_sql(scores: Column) -> Column:
    """Halve the generic entry once per specific database that beats it, in list order."""
    rivals = F.array(*[F.coalesce(score(scores, d), F.lit(-1.0)) for d in databases.SPECIFIC_SQL])
    generic = score(scores, "SQL Database")
    left = F.aggregate(rivals, generic, lambda g, r: F.when(r > g, divided(g, 2)).otherwise(g))
    return F.when(generic.isNotNull(), with_score(scores, "SQL Database", left)).otherwise(scores)


DATABASE_STEPS = [
    _update("databases", _without_connection),
    lambda: {"databases": add_all(F.col("databases"), F.col("`databases+extra`"))},
    _update("databases", _generic_sql),
    1,
]


# Build systems and package managers.


def _plus(scores: Column, tech: str, condition: Column, points: Column | int) -> Column:
    """Add points to a technology, creating it, where a condition holds."""
    value = F.coalesce(score(scores, tech), F.lit(0.0)) + points
    return F.when(condition, with_score(scores, tech, value)).otherwise(scores)


def _used(scores: Column) -> Column:
    usage = _text_list(build.USAGE)

    def change(k, v):
        used = F.array_contains(usage, k) & F.array_contains("flags", F.concat(F.lit("usage:"), k))
        return F.when(used, v + 10).otherwise(v)

    return F.transform_values(scores, change)


def _split_pair() -> tuple[Column, Column]:
    """Front and back directory of the first pair that a repository has."""
    front = back = F.lit(None).cast("string")
    for f, b in reversed(build.SPLIT_DIRECTORIES):
        both = flagged(f"top:{f}") & flagged(f"top:{b}")
        front, back = F.when(both, F.lit(f)).otherwise(front), F.when(both, F.lit(b)).otherwise(back)
    return front, back


def _split_repository(scores: Column) -> Column:
    front, back = _split_pair()
    has = lambda prefix, side: F.coalesce(F.array_contains("flags", F.concat(F.lit(prefix), side)), F.lit(False))
    return _plus(_plus(scores, "npm", has("topnpm:", front), 30), "pip", has("toppip:", back), 30)


def _npm_floor(scores: Column) -> Column:
    npm = score(scores, "npm")
    low = scored(scores, "pip") & (npm > 0) & (npm < 10)
    return F.when(low, with_score(scores, "npm", F.lit(10.0))).otherwise(scores)


BUILD_STEPS = [
    _update("build_systems", _used),
    1,
]
PACKAGE_STEPS = [
    _update("package_managers", _split_repository),
    _update("package_managers", _used),
    _update("package_managers", lambda m: _plus(m, "npm", F.col("package_json"), 20)),
    _update("package_managers", lambda m: _plus(m, "npm", F.col("package_json") & F.col("first_manifest_declares"), 10)),
    _update("package_managers", lambda m: _plus(m, "pip", F.col("pip_declarations") > 0, F.col("pip_declarations") * 10)),
    _update("package_managers", lambda m: _plus(m, "pip", F.col("pip_file"), 20)),
    1,
    _update("package_managers", _npm_floor),
]


def cross_listed(row: DataFrame) -> DataFrame:
    """Align technologies listed as build system and package manager with unequal confidence."""

    def aligned(own: Column, other: Column) -> Column:
        def change(k, v):
            rival = F.try_element_at(other, k)["confidence"]
            behind = rival - v["confidence"] > 20
            return F.struct(
                v["matches"].alias("matches"),
                F.when(behind, F.greatest(rival - 10, v["confidence"])).otherwise(v["confidence"]).alias("confidence"),
            )

        return F.transform_values(own, change)

    build_systems, managers = F.col("build_systems"), F.col("package_managers")
    return row.withColumns(
        {"build_systems": aligned(build_systems, managers), "package_managers": aligned(managers, build_systems)}
    )


# Frontend.

FRONTEND_STEPS = [1]


# DevOps.


def _implies(tech: str, implied: str):
    """A technology lifts the one it builds on to five points below its own."""

    def change(scores: Column) -> Column:
        own, other = score(scores, tech), score(scores, implied)
        behind = own.isNotNull() & other.isNotNull() & (other < own)
        return F.when(behind, with_score(scores, implied, F.greatest(other, own - 5))).otherwise(scores)

    return _update("devops", change)


def _cdk_is_aws() -> dict[str, Column]:
    scores = F.col("devops")
    cdk = score(scores, "AWS CDK")
    lifted = with_score(scores, "AWS", F.greatest(F.coalesce(score(scores, "AWS"), F.lit(0.0)), cdk - 5))
    cloud = F.create_map(F.lit("AWS"), F.lit(100 + devops.SUB_CATEGORIES.index("cloud")))
    categories = F.map_concat(F.map_filter("devops_category", lambda k, _: k != "AWS"), cloud)
    return {
        "devops": F.when(cdk.isNotNull(), lifted).otherwise(scores),
        "devops_category": F.when(cdk.isNotNull(), categories).otherwise(F.col("devops_category")),
    }


DEVOPS_STEPS = [
    _implies("Docker Compose", "Docker"),
    _implies("Helm", "Kubernetes"),
    _cdk_is_aws,
    1,
]


# Architecture.


def _directory_points() -> dict[str, Column]:
    """Full directory set 20, at least 70 % of it 10, else 2 per directory found."""
    present = F.map_keys(F.col("`architecture+directory`"))
    table = F.from_json(
        F.lit(json.dumps([{"tech": t, "sets": [list(s) for s in sets]} for t, sets in architecture.DIRECTORY_SETS.items()])),
        "array<struct<tech:string,sets:array<array<string>>>>",
    )

    def points(members):
        found = F.size(F.array_intersect(present, members))
        size = F.size(members)
        return F.when(found == size, 20).when(found >= size * 0.7, 10).otherwise(found * 2)

    def total(entry):
        summed = F.aggregate(F.transform(entry["sets"], points), F.lit(0), lambda a, p: a + p)
        return F.struct(entry["tech"].alias("tech"), summed.cast("double").alias("points"))

    return {"architecture": add_all(F.col("architecture"), _positive(F.transform(table, total)))}


def _positive(entries: Column) -> Column:
    return F.map_from_entries(F.filter(entries, lambda e: e["points"] > 0))


def _file_points() -> dict[str, Column]:
    """Five points for every file name pattern seen at least once."""
    seen = F.transform(F.map_keys(F.col("`architecture+file`")), lambda k: F.substring_index(k, "/", 1))

    def total(tech):
        return F.struct(tech.alias("tech"), (F.size(F.filter(seen, lambda s: s == tech)) * 5.0).alias("points"))

    totals = F.transform(_text_list(architecture.FILE_PATTERNS), total)
    return {"architecture": add_all(F.col("architecture"), _positive(totals))}


def convention_count(index: int) -> Column:
    signs = architecture.CONVENTIONS[index][3]
    wanted = _text_list([f"convention:{index}:{s}" for s in signs])
    return F.size(F.array_intersect(F.col("flags"), wanted))


def _convention_points() -> dict[str, Column]:
    scores = F.col("architecture")
    by_tech: dict[str, list[Column]] = {}
    for i, (tech, points, needed, _, _) in enumerate(architecture.CONVENTIONS):
        by_tech.setdefault(tech, []).append(F.when(convention_count(i) >= needed, float(points)).otherwise(0.0))
    totals = [
        F.struct(F.lit(tech).alias("tech"), reduce(Column.__add__, parts).alias("points"))
        for tech, parts in by_tech.items()
    ]
    return {"architecture": add_all(scores, _positive(F.array(*totals)))}


def _module_points(scores: Column) -> Column:
    return _plus(scores, "Feature-based architecture", F.col("modules").isNotNull(), 25)


def _rest_boost(scores: Column) -> Column:
    return _plus(scores, "REST API", scored(scores, "REST API") & flagged("rest"), 10)


def _exclusive(scores: Column) -> Column:
    mvc, mvvm = score(scores, "MVC"), score(scores, "MVVM")
    return (
        F.when(mvc > mvvm, with_score(scores, "MVVM", divided(mvvm, 3)))
        .when(mvc <= mvvm, with_score(scores, "MVC", divided(mvc, 3)))
        .otherwise(scores)
    )


ARCHITECTURE_STEPS = [
    _directory_points,
    _file_points,
    _convention_points,
    _update("architecture", _module_points),
    1,
    _update("architecture", _rest_boost),
    _update("architecture", _exclusive),
    2,
]


# Testing.


def _coverage() -> dict[str, Column]:
    name = "High Test Coverage"
    covered = F.col("covered_extensions") > 0
    kind = F.create_map(F.lit(name), F.lit(testing.SUB_CATEGORIES.index("coverage")))
    return {
        "testing": _plus(F.col("testing"), name, covered, F.col("covered_extensions") * 10),
        "testing_category": F.when(covered, F.map_concat("testing_category", kind)).otherwise(F.col("testing_category")),
    }


TESTING_STEPS = [1, _coverage]

# Functions of the score row, and stages at which the corrections of ``rules.conditions`` follow.
STEPS = {
    "frameworks": FRAMEWORK_STEPS,
    "databases": DATABASE_STEPS,
    "build_systems": BUILD_STEPS,
    "package_managers": PACKAGE_STEPS,
    "frontend": FRONTEND_STEPS,
    "devops": DEVOPS_STEPS,
    "architecture": ARCHITECTURE_STEPS,
    "testing": TESTING_STEPS,
}


def detected(row: DataFrame, detectors: list[str], corrections: Sequence[Correction] = CORRECTIONS) -> DataFrame:
    """Corrected, normalised and thresholded maps: tech -> (matches, confidence)."""
    row = corrected(row, detectors, corrections)
    row = row.withColumns({d: normalised(F.col(d), *THRESHOLDS[d]) for d in detectors})
    if "build_systems" in detectors and "package_managers" in detectors:
        row = cross_listed(row)
    return row


def sub_category(detector: str, code: Column) -> Column:
    """Name of a sub-category code."""
    names = {
        "frontend": frontend.SUB_CATEGORIES,
        "devops": devops.SUB_CATEGORIES,
        "testing": testing.SUB_CATEGORIES,
    }[detector]
    return F.get(_text_list(names), F.pmod(code, F.lit(100)))


def languages_from_counts(counts: Column) -> Column:
    """lang -> (matches, confidence, percentage) of weighted file counts."""
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(
        counts,
        lambda _, v: F.struct(
            v.alias("matches"),
            exact_round(F.least(F.lit(100.0), v / total * 100 * 2), 2).alias("confidence"),
        ),
    )
