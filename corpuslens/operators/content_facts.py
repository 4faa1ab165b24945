"""Facts that need a file's text but no rule: computed in the same pass as the rules.

Each function returns an array column of hit structs over ``path``, ``name``, ``content`` and ``shown``, the name
that evidence mentions.  What they ask of a path is listed in ``path_traits``: files of equal content and traits
have equal facts.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import paths
from corpuslens.functions.text import has_requirement_line, manifest_sections
from corpuslens.rules import devops, frameworks, frontend, testing
from corpuslens.rules.ruleset import DEPENDENCY_RANK, FILE_RANK, NAME_RANK, listed

SHAPE_FLAGS = [
    "package_json", "pip_file", "valid_pom", "valid_gradle", "valid_webpack", "django_files", "jsx_files",
    "tailwind_file", "javascript_files", "ruby_files",
]


def hit(detector, tech, points: float = 0.0, category=-1, step: int = 0, ordinal=0, evidence=None) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(detector).alias("detector"), as_column(tech).alias("tech"), as_column(points).cast("double").alias("points"),
        as_column(category).cast("int").alias("category"), as_column(step).cast("int").alias("step"),
        as_column(ordinal).cast("int").alias("ordinal"), as_column(evidence).cast("string").alias("evidence"),
    )


def _has(*words: str) -> Column:
    return reduce(Column.__and__, [F.contains("content", F.lit(w)) for w in words])


def _ends(*suffixes: str) -> Column:
    return reduce(Column.__or__, [F.endswith("path", F.lit(s)) for s in suffixes])


def _in_path(*words: str) -> Column:
    return reduce(Column.__or__, [F.contains("path", F.lit(w)) for w in words])


# What the facts ask of a path alone.
_PATH_TESTS = {
    "package.json": lambda: _ends("package.json"),
    "pip file": lambda: _ends("requirements.txt", "setup.py"),
    "setup.py": lambda: _ends("setup.py"),
    "pom.xml": lambda: _ends("pom.xml"),
    "gradle": lambda: _ends("build.gradle", "build.gradle.kts"),
    "webpack": lambda: F.contains(F.lower("path"), F.lit("webpack")) & _ends(".js"),
    "django": lambda: _in_path("settings.py", "urls.py", "manage.py"),
    "jsx": lambda: _ends(".jsx", ".tsx"),
    "tailwind": lambda: _in_path("tailwind.config.js"),
    "javascript": lambda: _ends(".js", ".jsx", ".ts", ".tsx"),
    "ruby": lambda: _ends(".rb"),
    "manifest": lambda: F.col("name") == "package.json",
}


def _language() -> Column:
    known = F.from_json(F.lit(json.dumps(frameworks.SOURCE_LANGUAGE)), "map<string,string>")
    return F.try_element_at(known, paths.loose_extension(F.col("path")))


def path_traits() -> Column:
    """Names of the tests that a path passes, and its source language."""
    return F.array_compact(F.array(*[F.when(test(), F.lit(trait)) for trait, test in _PATH_TESTS.items()], F.concat(F.lit("language "), _language())))


def shapes() -> Column:
    """Flags from file kinds and file structure, declared Python packages, manifests."""
    is_ = lambda trait: _PATH_TESTS[trait]()
    tests = {
        "package_json": is_("package.json"),
        "pip_file": is_("pip file"),
        "valid_pom": is_("pom.xml") & _has("<project", "<artifactId>") & (_has("<groupId>") | _has("<parent>")),
        "valid_gradle": is_("gradle") & _has("repositories", "dependencies"),
        "valid_webpack": is_("webpack") & _has("module.exports") & (_has("entry") | _has("output") | _has("module")),
        "django_files": is_("django"),
        "jsx_files": is_("jsx"),
        "tailwind_file": is_("tailwind"),
        "javascript_files": is_("javascript"),
        "ruby_files": is_("ruby"),
    }
    entries = [F.when(tests[name], hit("flag", f"fact:{name}")) for name in SHAPE_FLAGS]
    declared = (is_("pip file") & ~is_("setup.py") & has_requirement_line(F.col("content"))) | (
        is_("setup.py") & _has("install_requires", "[", "]")
    )
    entries.append(F.when(declared, hit("count", "pip_declarations", 1.0)))
    parsed = F.from_json("content", "dependencies string, devDependencies string")
    declares = F.coalesce(parsed["dependencies"].isNotNull() | parsed["devDependencies"].isNotNull(), F.lit(False))
    entries.append(F.when(is_("package.json"), hit("manifest", F.when(declares, "declares").otherwise("plain"))))
    return F.array_compact(F.array(*entries))


def source_languages() -> Column:
    """The language of a readable source file."""
    language = _language()
    return F.array_compact(F.array(F.when(language.isNotNull(), hit("source_language", language, 1.0))))


def specials() -> Column:
    """Container, orchestration and workflow files recognised by several words together."""
    entries = [
        ("Docker", "containerization", "Found Dockerfile-like content in: ",
         _has("FROM ", "RUN ") & (_has("WORKDIR ") | _has("COPY ") | _has("CMD "))),
        ("Kubernetes", "containerization", "Found Kubernetes manifest in: ",
         _has("apiVersion: ", "kind: ", "metadata:", "spec:")),
        ("GitHub Actions", "cicd", "Found GitHub Actions workflow in: ",
         _has("name: ", "on: ", "jobs:", "steps:", "uses: ")),
    ]
    scanned = F.col("content").isNotNull()
    return F.array_compact(F.array(*[
        F.when(test & scanned, hit(
            "devops", tech, 15.0, FILE_RANK + devops.SUB_CATEGORIES.index(category), 4, 0, F.concat(F.lit(label), "shown")))
        for tech, category, label, test in entries
    ]))


def dependencies(detectors) -> Column:
    """Frontend and testing technologies of the packages a manifest names, per section."""
    table: dict[str, list[dict]] = {}

    def add(package, detector, tech, category, step):
        row = {"detector": detector, "tech": tech, "category": category, "step": step, "ordinal": len(table)}
        table.setdefault(package, []).append(row)

    if "frontend" in detectors:
        for package, (tech, category) in frontend.DEPENDENCIES.items():
            add(package, "frontend", tech, NAME_RANK + frontend.SUB_CATEGORIES.index(category), 2)
    if "testing" in detectors:
        for tech, packages in testing.NPM.items():
            rank = DEPENDENCY_RANK + testing.SUB_CATEGORIES.index(listed(testing.NPM_CATEGORY, tech))
            for package in packages:
                add(package, "testing", tech, rank, 3)
    known = F.from_json(
        F.lit(json.dumps(table)),
        "map<string,array<struct<detector:string,tech:string,category:int,step:int,ordinal:int>>>",
    )
    scanned = F.col("content").isNotNull()
    sections = manifest_sections(F.col("content"))

    def of_section(section: str) -> Column:
        named = F.filter(F.map_keys(sections[section]), lambda p: F.map_contains_key(known, p))

        def rows(package):
            allowed = F.filter(F.try_element_at(known, package), lambda r: scanned | (r["detector"] != "frontend"))
            return F.transform(allowed, lambda r: hit(
                r["detector"], r["tech"], 15.0, r["category"], r["step"], r["ordinal"],
                F.concat(F.lit(f"Found in {section}: "), package)))

        return F.flatten(F.transform(named, rows))

    empty = F.filter(F.array(hit("", "")), lambda _: F.lit(False))
    found = [F.coalesce(of_section(s), empty) for s in ("dependencies", "devDependencies")]
    return F.when(_PATH_TESTS["manifest"](), F.concat(*found)).otherwise(empty)


def wanted_facts(detectors) -> list[Column]:
    """The fact columns that a set of detectors reads."""
    wanted = set(detectors)
    columns = []
    if wanted & {"frameworks", "build_systems", "package_managers", "frontend", "testing"}:
        columns.append(shapes())
    if "frameworks" in wanted:
        columns.append(source_languages())
    if "devops" in wanted:
        columns.append(specials())
    if wanted & {"frontend", "testing"}:
        columns.append(dependencies(wanted))
    return columns
