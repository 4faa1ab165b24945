import pytest
from pyspark.sql import functions as F

from corpuslens.operators import content_facts, scan
from corpuslens.plans.analysis import DETECTORS
from corpuslens.rules.ruleset import default_rules
from corpuslens.sources.corpus import from_table
from corpuslens.sources.derived import derived_corpus


def facts():
    return content_facts.wanted_facts(DETECTORS)


def both(files, rules):
    order = lambda df: sorted(map(str, df.select(*scan.HIT_COLUMNS).collect()))
    return order(scan.content_hits(files, rules, facts(), copies=False)), order(scan.content_hits(files, rules, facts(), copies=True))


def test_every_path_gets_the_hits_of_its_content(spark):
    files = from_table(derived_corpus(spark, "/root/testdata/sf0.001"))
    plain, shared = both(files, default_rules())
    assert plain == shared and len(plain) > 1000
    n, scanned = files.where("content is not null").count(), scan.distinct_contents(files, default_rules()).count()
    assert scanned < n / 5 and scan._has_copies(scan._places(files, default_rules()))


@pytest.mark.parametrize("name", ["package.json", "x.py", "Dockerfile", "webpack.config.js", "requirements.txt", "setup.py", "a.b.go"])
def test_names_decide_what_a_content_means(spark, name):
    """The same texts under many names, one path a third of all, and texts that hold the name's stand-in."""
    texts = [
        '{"dependencies": {"react": "18"}, "devDependencies": {"jest": "29"}}', "FROM x\nRUN y\nWORKDIR /z\n", "module.exports = { entry: 1 }", "flask==2\npytest\n",
        "import flask\nfrom setuptools import setup\ninstall_requires=['x']", f"import flask {scan._SHOWN_NAME}\nFROM a\nRUN b\nCOPY c", "",
    ]
    names = [name, "deep/" + name, "tests/" + name, "other.txt", "package.json", "m.js"]
    rows = [(f"r{i % 3}", f"{i}/{n}", t) for i, (n, t) in enumerate((n, t) for t in texts for n in names)] + [("hot", f"h{i}/{name}", texts[0]) for i in range(20)] + [("r0", "none", None)]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string").withColumn("size", F.lit(1).cast("bigint"))
    plain, shared = both(files, default_rules())
    assert plain == shared and plain


def test_different_contents_are_scanned_in_place(spark):
    files = spark.range(300).select(F.lit("r").alias("repo_id"), F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("import flask # "), "id").alias("content"))
    assert not scan._has_copies(scan._places(files, default_rules()))
    assert "Exchange" not in scan.content_hits(files, default_rules(), facts())._jdf.queryExecution().executedPlan().toString()


def test_patterns_of_path_rules_are_constants(spark):
    """A pattern taken from a rule of a lambda would be compiled again for every candidate of every path."""
    import re

    from corpuslens.rules.ruleset import path_regex

    names = ["tests/test_a.py", "src/UserController.java", "app/models/item.rb", "app/models/", "x/OrderTest.java", "README.md", "spec/a_spec.rb", "modelsX.py"]
    rules, path = default_rules(), F.col("path")
    files = spark.createDataFrame([("r", p) for p in names], "repo_id string, path string")
    plan = scan.path_hits(files, rules)._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"RLIKE\([^,()]+, lambda", plan)
    name = F.regexp_extract(path, "[^/]*$", 0)
    direct = [F.rlike(name if r.kind == "match" else path, F.lit(path_regex(r))) for r in rules.path_rules if r.kind in ("match", "search")]
    wanted = sorted({f"{r.kind} {path_regex(r)}" for r in rules.path_rules if r.kind in ("match", "search")})
    row = files.select(path, scan._patterns_met(rules, path, name).alias("met"), F.array(*direct).alias("direct")).collect()
    for r in row:
        kinds = [f"{x.kind} {path_regex(x)}" for x in rules.path_rules if x.kind in ("match", "search")]
        assert sorted(r.met) == sorted({k for k, yes in zip(kinds, r.direct, strict=True) if yes}) and set(r.met) <= set(wanted)


def test_binary_texts_are_told_by_their_share_of_control_characters(spark):
    from corpuslens.functions.text import is_binary_text

    texts = ["", "plain\n\ttext", "\x00", "a" * 9 + "\x00", "a" * 8 + "\x07" * 2, "\x1f" * 3 + "ä" * 30, "\x1f" * 3 + "ä" * 26, "line \x0b\x0c x", None]
    control = set(range(9)) | {11, 12} | set(range(14, 32))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", is_binary_text(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [None if t is None else sum(ord(c) in control for c in t) * 10 > len(t) for t in texts]
