from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import paths
from corpuslens.operators import content_facts, facts, scan, scores
from corpuslens.plans import analysis
from corpuslens.rules.ruleset import default_rules
from corpuslens.sources.corpus import from_table

NUMBERS = ["7", "12", "345", "99999"]
PATHS = [
    "api/v{}/users.py", "s{}/main.tf", "k{}s/d.yaml", "pkg{}/package.json", "src/models/user{}.js", "log.{}", "Makefile{}", "a{}/Test{}.java",
    "k{}.js", "nunit{}-console.exe", "tests/e{}e/x.{}", "ec{}/y.tf",
]


@pytest.fixture(scope="module")
def files(spark):
    texts = ["from flask import Flask\nimport sqlite3\n", '{"dependencies": {"react": "18"}}', "plain"]
    rows = [(f"r{r}", p.format(n, n), texts[i % 3] if i % 4 else None) for r in range(2) for i, p in enumerate(PATHS) for n in [*NUMBERS, "8", "3"]]
    return from_table(spark.createDataFrame(rows, "repo_id string, path string, content string"))


def test_only_long_numbers_are_alike(spark):
    rows = spark.createDataFrame([(p.format(n, n),) for p in PATHS for n in NUMBERS], "path string")
    shapes = defaultdict(set)
    for path, shape in rows.select("path", scan.path_shape(F.col("path"), default_rules())).collect():
        shapes[shape].add(path)
    assert shapes["src/models/user00.js"] == {f"src/models/user{n}.js" for n in NUMBERS[1:]}
    for alone in ("api/v345/users.py", "log.345", "Makefile345", "k7s/d.yaml"):
        assert shapes[alone] == {alone}


def test_grouped_hits_sum_to_the_hits_of_all_files(files):
    rules = default_rules()
    hits = analysis.detector_hits(files, rules, analysis.DETECTORS, copies=False)
    groups = scan.file_groups(files, rules)
    assert scan.groups_pay(groups) and groups.count() < files.count()
    sums, manifests = scan.grouped_hits(files, groups, rules, content_facts.wanted_facts(analysis.DETECTORS))
    ordered = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    assert ordered(scores.tallies(sums)) == ordered(scores.tallies(hits))
    assert ordered(facts.first_manifests(manifests)) == ordered(facts.first_manifests(hits))
    for fact in (facts.language_counts, facts.component_counts, facts.test_source_ratio):
        assert ordered(fact(groups)) == ordered(fact(files))


def test_rules_on_single_digits_keep_paths_apart():
    for pattern in (r"\d{4}", "a.b", "[0-3]+x", r"v\d", "a(1|2)"):
        assert scan._plain_text(pattern) is None
    assert scan._plain_text(r"([\p{L}\p{N}_]+)View\.[\p{L}\p{N}_]+") == "(/)View./"


def test_excluded_directories_are_whole_components(spark):
    found = spark.createDataFrame([("bin/a",), ("x/.git/a",), ("x/bin",), ("robin/a",), ("xgit/a",), ("x/bin/",)], "path string")
    kept = found.where(~paths.in_excluded_directory(F.col("path"), ["bin", ".git", "a/b"])).collect()
    assert [r.path for r in kept] == ["x/bin", "robin/a", "xgit/a"]
