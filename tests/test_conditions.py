from dataclasses import replace

import pytest

from corpuslens import analyze
from corpuslens.operators import recommend
from corpuslens.operators.conditions import checked
from corpuslens.operators.facts import repository_facts
from corpuslens.rules.conditions import ADVICE, FLAGS, Advice, Correction, Flag
from corpuslens.rules.ruleset import default_rules
from corpuslens.sources.corpus import from_table

FILES = [
    ("a", "Dockerfile", "FROM python:3\nWORKDIR /x\nRUN pip install flask\nCOPY . .\n"), ("a", "app.py", "from flask import Flask\napp = Flask(__name__)\n"),
    ("b", "Dockerfile", "FROM python:3\nWORKDIR /x\nRUN pip install flask\nCOPY . .\n"), ("b", "requirements.txt", "flask==2\n"), ("c", "notes.txt", None),
]


@pytest.fixture(scope="module")
def files(spark):
    return from_table(spark.createDataFrame(FILES, "repo_id string, path string, content string"))


def test_a_rule_of_each_kind(spark, files):
    """A flag, a conflict, a practice and a correction, given as rows."""
    flags = (*FLAGS, Flag("strong_docker", "category = 'devops' and tech = 'Docker' and confidence > 60"))
    advice = (
        *ADVICE, Advice("boxed", "conflict", "strong_docker and not testing", "Test the image", "Images break", "high"),
        Advice("nothing", "practice", "not flask and not docker", "Write something", "Empty", "low"),
    )
    found = analyze(files)
    rows = recommend.recommendations(found.scored, found.primary, repository_facts(found.files), flags=flags, advice=advice)
    own = {(r.repo_id, r.text, r.source) for r in rows.collect() if r.text in ("Test the image", "Write something")}
    assert own == {("a", "Test the image", "compatibility_analysis"), ("b", "Test the image", "compatibility_analysis"), ("c", "Write something", "best_practices")}
    both = {r.text for r in rows.where("repo_id = 'c'").collect()}
    assert {"Consider using Git for version control", "Write something"} <= both

    docker = lambda result: {r.repo_id: r.matches for r in result.scored.where("tech = 'Docker' and category = 'devops'").collect()}
    plain, rules = docker(found), default_rules()
    halved = docker(analyze(files, replace(rules, corrections=(*rules.corrections, Correction("devops", "Docker", "pip_file")))))
    assert plain["a"] == plain["b"] == halved["b"] and halved["a"] == plain["a"] // 2


@pytest.mark.parametrize(("text", "said"), [
    ("nowhere", "UNRESOLVED"), ("n + 1", "BOOLEAN"), ("flag and", "PARSE"), ("flag and (", "PARSE"), ("max(n) > 1", ""), ("rand() > 0.5", "may change"),
    ("n in (select 1)", "subquery"), ("row_number() over (order by n) = 1", ""),
])
def test_conditions_are_checked(spark, text, said):
    rows = spark.createDataFrame([(True, 1)], "flag boolean, n int")
    with pytest.raises(ValueError, match="'bad'") as problem:
        checked(rows, [("good", "flag and n > 0"), ("bad", text)])
    assert said.lower() in str(problem.value).lower()


def test_null_is_false_and_names_are_unique(spark):
    rows = spark.createDataFrame([(None, 1)], "flag boolean, n int")
    held = checked(rows, [("a", "flag"), ("b", "flag or n = 1")])
    assert tuple(rows.select(held["a"], held["b"]).first()) == (False, True)
    assert checked(rows, []) == {}
    with pytest.raises(ValueError, match="same name"):
        checked(rows, [("a", "flag"), ("a", "not flag")])
