"""All content rules over pages, against SQL and plain counts."""

import re

import duckdb

from checks.queries import CHECKS
from corpuslens.rules.ruleset import DEPENDENCY_RANK, default_rules

PAGES = [
    (1, "http://a/app.py", "from flask import Flask\nfrom sqlalchemy import create_engine\n@app.route('/x')\nimport pytest\n@pytest.fixture\n" * 12),
    (2, "http://a/requirements.txt", "flask==2.0\npsycopg2==2.9\npytest==7.0\nSELECT a FROM b WHERE c = 1;\n"),
    (3, "http://a/Gemfile", "gem 'rspec'\ngem 'rails'\n"),
    (4, "http://a/build.sh", "mvn clean install && npm install\ndocker build .\n"),
    (5, "http://a/x.html", "<div ng-app='x'>{% block a %}{{ b }}{% endblock %} mongodb://u:p@h/db <script>import React from 'react'</script></div>"),
]


def test_all_rules_on_pages(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    check = CHECKS["page_content_rule_hits"]
    got = {tuple(r) for r in check.run(spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == set(connection.sql(check.sql).fetchall())
    assert {d for _, d, _, _ in got} >= {"flag", "frameworks", "databases", "build_systems", "frontend", "testing"}
    dependencies = {r.tech for r in default_rules().content_rules if r.category >= DEPENDENCY_RANK and r.scope == "python_manifest" and r.pattern == "pytest"}
    assert dependencies and all(any(i == 2 and t == tech for i, _, t, _ in got) for tech in dependencies)
    plain = {}
    for rule in default_rules().content_rules:
        if rule.detector == "build_systems" and rule.kind == "regex" and rule.scope in ("all", "text"):
            for page, _, body in PAGES:
                n = len(re.findall(rule.pattern, body, re.I if rule.ignore_case else 0))
                if n:
                    plain[page, rule.tech] = plain.get((page, rule.tech), 0) + n * rule.weight
    assert plain == {(i, t): p for i, d, t, p in got if d == "build_systems"}
