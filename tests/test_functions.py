import re

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import numbers, paths, text
from corpuslens.functions.literals import literal_search_pattern, literals_found, minimal_literals
from corpuslens.functions.regex import anchors, to_java
from corpuslens.rules.ruleset import content_gate, default_rules
from corpuslens.sources.derived import SNIPPETS


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", expr(F.col("v")).alias("o")).collect())]


def test_extension_follows_splitext(spark):
    import os

    names = [".bashrc", "..a.b", "a.", "x.tar.gz", "plain", "a.b", "...", ".a.b.c", "UPPER.PY"]
    assert column(spark, names, paths.extension) == [os.path.splitext(n)[1] for n in names]


def test_excluded_directory_spares_file_names(spark):
    got = column(spark, ["build/x.py", "src/build", "a/dist/b/c", "distx/y"], lambda p: paths.in_excluded_directory(p, ["build", "dist"]))
    assert got == [True, False, True, False]


def test_ancestors_skip_hidden_roots(spark):
    assert column(spark, ["a/b/c.py", "x", ".g/h/i"], paths.ancestor_directories) == [["a", "a/b"], [], []]


def test_binary_sniff_and_blank(spark):
    values = ["\x01" * 11 + "a" * 89, "\x01" * 10 + "a" * 90, " \n\t", "a"]
    assert column(spark, values, text.is_binary_text) == [True, False, False, False]
    assert column(spark, values, text.is_blank) == [False, False, True, False]


def test_lossy_decode_drops_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc3\xa9"),)], "b binary")
    assert df.select(text.decode_lossy(F.col("b"))).first()[0] == "abé"


def test_requirement_lines(spark):
    values = ["# a==1\n\n", "flask\n", "  flask==1", "\t# x=1\n y=2"]
    assert column(spark, values, text.has_requirement_line) == [False, False, True, True]


def test_rounding_matches_python(spark):
    values = [1.285, 2.675, 62.25, 66.65, 14.625, 99.995, 33.333333, 100.0, 5.05, 12.35, 21.55, 50.85, 19.35, 21.05, 46.35]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", numbers.exact_round(F.col("v"), 2), numbers.one_decimal(F.col("v"))).collect()
    assert [(r[1], r[2]) for r in rows] == [(round(v, 2), f"{v:.1f}") for v in values]


def test_java_patterns_count_like_python(spark):
    rules = [r for r in default_rules().content_rules if r.kind == "regex"]
    texts = [c for _, c in SNIPPETS] + ["café = déf\nclass ÉtéModel", "import React", "plugins   {\n  x\n}", "it works"]
    patterns = sorted({(r.pattern, r.ignore_case) for r in rules})
    frame = spark.createDataFrame([(i, to_java(p, ic)) for i, (p, ic) in enumerate(patterns)], "p int, java string")
    bodies = spark.createDataFrame(list(enumerate(texts)), "t int, body string")
    counted = bodies.join(frame, F.expr("p >= 0")).select("t", "p", F.regexp_count("body", F.col("java")).alias("n")).collect()
    for row in counted:
        pattern, ic = patterns[row.p]
        expected = len([m for m in re.finditer(pattern, texts[row.t], re.IGNORECASE if ic else 0)])
        assert row.n == expected, (pattern, texts[row.t])


def test_gates_never_hide_a_match():
    texts = [c for _, c in SNIPPETS]
    for rule in default_rules().content_rules:
        if rule.kind in ("regex", "exists"):
            flags = re.IGNORECASE if rule.ignore_case else 0
            for body in texts:
                if re.search(rule.pattern, body, flags):
                    seen = body.lower() if rule.ignore_case else body
                    assert any(a in seen for a in content_gate(rule)), rule.pattern


@pytest.mark.parametrize("pattern,expected", [
    (r"postgres(?:ql)?://", ["postgres"]), (r"(?:DB_HOST|MYSQL_HOST)", ["DB_HOST", "MYSQL_HOST"]),
    (r"\w+", []), (r"A_B|CD_E\w+", ["A_B", "CD_E"]),
])
def test_anchors(pattern, expected):
    assert anchors(pattern) == expected


def test_literal_search_finds_what_contains_finds(spark):
    literals = ["react", "preact", "import ", "from", "om re", "$.", "a(b", "x[1]", "app.get(", "app.post("]
    minimal, representative = minimal_literals(literals)
    assert "preact" not in minimal and representative["preact"] == "react"
    values = ["import preact from react", "app.get( app.post(", "$.x a(b x[1]", "", "frfrom"]
    got = column(spark, values, lambda v: literals_found(v, minimal))
    assert [set(g) for g in got] == [{m for m in minimal if m in v} for v in values]
    re.compile(literal_search_pattern(minimal))


def test_rounding_equals_python(spark):
    import random

    from corpuslens.functions.numbers import exact_round, one_decimal

    rnd = random.Random(1)
    values = [0.005, -5.25, 20000.0, -0.0, -0.04, 2.675, 1e-7, 1e6 + 0.005, float("inf"), 1e17, 1e-300]
    values += [10 ** rnd.uniform(-6, 6) * rnd.choice([1, -1]) for _ in range(3000)] + [rnd.randint(-10**6, 10**6) / 200 for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", exact_round(F.col("v"), 2).alias("two"), one_decimal(F.col("v")).alias("one"))
    for r in rows.collect():
        assert str(r.two) == str(round(r.v, 2)) and (r.v == float("inf") or r.one == f"{r.v:.1f}"), r
