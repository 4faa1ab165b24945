"""End-to-end membership on four small repositories, and invariants of every stack."""

import pytest
from pyspark.sql import functions as F

from corpuslens import analyze
from corpuslens.sources.corpus import from_table, load_corpus

REPOSITORIES = {
    "python_repo": {
        "app/__init__.py": "from flask import Flask\nfrom flask_sqlalchemy import SQLAlchemy\napp = Flask(__name__)\napp.config['SQLALCHEMY_DATABASE_URI'] = 'postgresql://u:p@db/shop'\ndb = SQLAlchemy(app)\n",
        "app/models/user.py": "from app import db\nclass User(db.Model):\n    id = db.Column(db.Integer)\n    posts = db.relationship('Post')\n",
        "app/views/users.py": "from flask import jsonify\n@app.route('/api/users')\ndef users():\n    return jsonify([])\n@app.get('/api/x')\ndef x():\n    pass\n",
        "app/api/v1/items.py": "@app.get('/items')\ndef items():\n    pass\n@app.post('/items')\ndef add():\n    pass\n",
        "app/services/mail.py": "def send():\n    pass\n",
        "requirements.txt": "flask==2.0\nflask-sqlalchemy==2.5\npsycopg2-binary==2.9\npytest==7.0\n",
        "tests/test_app.py": "import pytest\n@pytest.fixture\ndef client():\n    pass\ndef test_one(client):\n    assert client\n",
        "Dockerfile": "FROM python:3.9\nWORKDIR /app\nCOPY . .\nRUN pip install -r requirements.txt\n",
        "docker-compose.yml": "services:\n  db:\n    environment:\n      POSTGRES_PASSWORD: x\n      POSTGRES_DB: y\n",
    },
    "node_repo": {
        "src/app.js": "const express = require('express')\nconst mongoose = require('mongoose')\nconst app = express()\nmongoose.connect('mongodb://localhost/db')\napp.use(express.json())\napp.get('/users', f)\napp.post('/users', g)\napp.listen(3000)\n",
        "src/models/user.js": "const mongoose = require('mongoose')\nmodule.exports = mongoose.model('User', new mongoose.Schema({}))\n",
        "src/controllers/userController.js": "exports.list = async (req, res) => res.json([])\n",
        "src/routes/users.js": "const router = express.Router()\nrouter.get('/users', c.list)\n",
        "package.json": '{"dependencies": {"express": "4", "mongoose": "6"}, "devDependencies": {"mocha": "9", "chai": "4"}, "scripts": {"test": "mocha"}}',
        "test/app.test.js": "const { expect } = require('chai')\ndescribe('x', function () {\n  before(function () {})\n  it('y', function () { expect(1).to.equal(1) })\n})\n",
        "Dockerfile": "FROM node:14\nWORKDIR /app\nRUN npm install\n",
        "docker-compose.yml": "services:\n  mongo:\n    environment:\n      MONGO_INITDB_DATABASE: db\n",
    },
    "mixed_repo": {
        "backend/app/main.py": "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/')\ndef root():\n    pass\n",
        "backend/app/models/database.py": "import sqlite3\nfrom sqlalchemy import create_engine, Column\nengine = create_engine('sqlite:///./app.db')\nconn = sqlite3.connect('app.db')\n",
        "backend/requirements.txt": "fastapi==0.70\nsqlalchemy==1.4\n",
        "frontend/package.json": '{"dependencies": {"react": "17", "react-dom": "17"}}',
        "frontend/src/App.js": "import React, { useState, useEffect } from 'react'\nfunction App() { const [u, setU] = useState([]); return null }\n",
        "frontend/src/components/UserList.js": "import React from 'react'\nexport default () => null\n",
        "docker-compose.yml": "services:\n  api:\n    build: ./backend\n",
        "backend/Dockerfile": "FROM python:3.9\nWORKDIR /app\nRUN pip install fastapi\n",
    },
    "minimal_repo": {"src/main.py": "print('hello')\n", "README.md": "# Hello\n"},
}


@pytest.fixture(scope="module")
def result(spark):
    rows = [(repo, path, body) for repo, files in REPOSITORIES.items() for path, body in files.items()]
    files = from_table(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    analysis = analyze(files)
    return {
        "stack": [r.asDict() for r in analysis.stack.collect()],
        "primary": {(r.repo_id, r.category): r.tech for r in analysis.primary.collect()},
    }


def members(result, repo, category):
    return {r["tech"] for r in result["stack"] if r["repo_id"] == repo and r["category"] == category}


def test_python_repository(result):
    has = lambda c: members(result, "python_repo", c)
    assert result["primary"]["python_repo", "languages"] == "Python"
    assert {"Flask", "SQLAlchemy"} <= has("frameworks")
    assert "PostgreSQL" in has("databases") and "pip" in has("package_managers")
    assert "Docker" in has("devops") and "PyTest" in has("testing")
    assert has("architecture") & {"REST API", "Layered Architecture"}
    assert not has("architecture") & {"GraphQL API", "Microservices"}


def test_node_repository(result):
    has = lambda c: members(result, "node_repo", c)
    assert result["primary"]["node_repo", "languages"] == "JavaScript"
    assert "Express" in has("frameworks") and "MongoDB" in has("databases") and "npm" in has("package_managers")
    assert "Docker" in has("devops") and "Mocha" in has("testing") and "REST API" in has("architecture")


def test_mixed_repository(result):
    has = lambda c: members(result, "mixed_repo", c)
    assert {"Python", "JavaScript"} <= has("languages") and {"FastAPI", "React"} <= has("frameworks")
    assert "SQLite" in has("databases") and {"pip", "npm"} <= has("package_managers") and "Docker" in has("devops")


def test_minimal_repository_detects_little(result):
    assert "Python" in members(result, "minimal_repo", "languages")
    # A lone character set among the frontend rules matches nearly any text, so frontend is left out.
    for category in ("frameworks", "databases", "build_systems", "package_managers", "devops", "architecture", "testing"):
        assert not members(result, "minimal_repo", category), category


def test_invariants(result):
    for row in result["stack"]:
        assert 15 <= row["confidence"] <= 100
        assert row["category"] == "languages" or len(row["evidence"]) <= 6


def test_result_does_not_depend_on_partitioning(spark):
    rows = [("r", p, b) for p, b in REPOSITORIES["node_repo"].items()]
    files = from_table(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    one, many = (
        sorted(map(str, analyze(files.repartition(n)).scored.collect())) for n in (1, 7)
    )
    assert one == many and one


def test_loading_finds_repositories(spark, tmp_path):
    for repo in ("a", "b"):
        (tmp_path / repo / ".git").mkdir(parents=True)
        (tmp_path / repo / ".git" / "HEAD").write_text("x")
        (tmp_path / repo / "src").mkdir()
        (tmp_path / repo / "src" / "m.py").write_bytes(b"x = 1\xff")
        (tmp_path / repo / ".gitignore").write_text("*.pyc")
        (tmp_path / repo / "build").mkdir()
        (tmp_path / repo / "build" / "o.py").write_text("z")
    (tmp_path / "loose").mkdir()
    (tmp_path / "loose" / "n.py").write_text("y")
    got = load_corpus(spark, str(tmp_path)).orderBy("repo_id", "path").collect()
    each = [(".gitignore", "*.pyc"), ("src/m.py", "x = 1")]
    assert [(r.repo_id, r.path, r.content) for r in got] == [(repo, *row) for repo in ("a", "b") for row in each]
    whole = load_corpus(spark, str(tmp_path / "a")).collect()
    assert {(r.repo_id, r.path) for r in whole} == {(".", ".gitignore"), (".", "src/m.py")}


def test_a_directory_without_markers_is_one_repository(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "m.py").write_text("x = 1")
    (tmp_path / "README.md").write_text("hello")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "n.js").write_text("y")
    got = load_corpus(spark, str(tmp_path)).collect()
    assert {(r.repo_id, r.path, r.content) for r in got} == {(".", "src/deep/m.py", "x = 1"), (".", "README.md", None)}


def test_large_files_are_read_whole(spark):
    body = "from flask import Flask\n" + "# filler\n" * 700_000
    files = from_table(spark.createDataFrame([("r", "app.py", body)], "repo_id string, path string, content string"))
    assert files.first().content == body
    assert "Flask" in {r.tech for r in analyze(files).scored.where("category = 'frameworks'").collect()}


def test_skewed_repository_keeps_every_hit(spark):
    """One repository with most of the files is scored like the sum of its files."""
    from corpuslens.plans.analysis import detector_hits
    from corpuslens.rules.ruleset import default_rules

    big = spark.range(3000).select(
        F.when(F.col("id") < 2500, "big").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("repo_id"),
        F.concat(F.lit("src/m"), F.col("id").cast("string"), F.lit("/Dockerfile")).alias("path"),
        F.lit("FROM python\nWORKDIR /x\nRUN y\n").alias("content"),
    )
    rules = default_rules().for_detectors(["devops"])
    sums = {r.repo_id: r.p for r in detector_hits(big, rules, ["devops"]).where("tech = 'Docker'").groupBy("repo_id").agg(F.sum("points").alias("p")).collect()}
    assert sums["big"] == 250 * sums["r1"]


def test_imbalances_are_evidence(spark):
    """Two of each component or a remark; the counts are those the correction looked at."""
    def files(repo, views):
        parts = ["models/a.py", "models/b.py", "controllers/a.py", "controllers/b.py", *[f"views/v{i}.py" for i in range(views)]]
        return [(repo, f"app/{p}", "x = 1\n") for p in parts]

    table = from_table(spark.createDataFrame(files("lopsided", 1) + files("balanced", 2), "repo_id string, path string, content string"))
    analysis = analyze(table)
    assert analysis.stack.where("category = 'architecture' and tech = 'MVC'").count() == 2
    remarks = analysis._evidence_hits().where("tech = 'MVC' and evidence like 'Imbalance%'").select("repo_id", "evidence").collect()
    assert [tuple(r) for r in remarks] == [("lopsided", "Imbalance in MVC components: Models (2), Views (1), Controllers (2)")]


def test_file_counts_need_no_scan(spark, monkeypatch):
    def scanned(*_, **__):
        raise AssertionError("contents were scanned")

    monkeypatch.setattr("corpuslens.plans.analysis._evaluated", scanned)
    files = from_table(spark.createDataFrame([("r", "a.py", "x"), ("r", "b.py", None), ("s", "c.go", "y")], "repo_id string, path string, content string"))
    assert sorted((r.repo_id, r.file_count) for r in analyze(files).meta.collect()) == [("r", 2), ("s", 1)]
