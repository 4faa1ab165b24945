from corpuslens.operators import answers, prompts
from corpuslens.sources import store
from pyspark.sql import functions as F

FENCE = "```"


def test_fenced_answers(spark):
    good = '{"technologies": [{"name": "Flask"}]}'
    raw = spark.createDataFrame(
        [("r", "bare", good), ("r", "tagged", f"x {FENCE}json\n{good}\n{FENCE} y"), ("r", "plain", f"{FENCE}\n{good}\n{FENCE}"),
         ("r", "broken", "{nope"), ("r", "failed", '{"error": "no"}')], "repo_id string, path string, answer string")
    rows = {r.path: r for r in answers.parse_answers(raw, "technologies").collect()}
    for name in ("bare", "tagged", "plain"):
        assert rows[name].success and rows[name].technologies[0].name == "Flask"
        assert (rows[name].technologies[0].category, rows[name].technologies[0].confidence, rows[name].suggestions) == ("unknown", 50.0, [])
    assert not rows["broken"].success and rows["broken"].error
    assert not rows["failed"].success and rows["failed"].error == "no"


def test_two_files_merge(spark):
    kind = "repo_id string, path string, technologies array<struct<name:string,category:string,confidence:double,evidence:array<string>>>, suggestions array<struct<text:string,severity:string,reason:string>>"
    df = spark.createDataFrame([
        ("r", "app.py", [("Flask", "framework", 90.0, ["a"]), ("SQLAlchemy", "library", 85.0, ["b"])], [("later", "medium", "x")]),
        ("r", "models.py", [("SQLAlchemy", "orm", 95.0, ["b", "c"]), ("SQLite", "database", 80.0, [])], [("now", "high", "y"), ("later", "low", "z")]),
    ], kind)
    found = {r.name: r for r in answers.merge_findings(df, "technologies", "category").collect()}
    assert len(found) == 3 and found["SQLAlchemy"].confidence == 95 and found["SQLAlchemy"].category == "library"
    assert found["SQLAlchemy"].evidence == ["b", "c"] and found["SQLite"].evidence == []
    assert [(r.text, r.severity) for r in answers.merge_suggestions(df).orderBy("nth").collect()] == [("now", "high"), ("later", "medium")]


def test_rendering_leaves_other_braces(spark):
    df = spark.createDataFrame([("x{code}",)], "c string")
    out = df.select(prompts.render("{a} {code} {other}", a=F.col("c"), code=F.lit("{a}"))).first()[0]
    assert out == "x{code} {a} {other}"


def test_store_appends_only_new_keys(spark, tmp_path):
    target = str(tmp_path / "store")
    first = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, result string")
    store.append_results(first, target)
    store.append_results(spark.createDataFrame([("k2", "other"), ("k3", "c")], "key string, result string"), target)
    assert sorted(map(tuple, store.stored_results(spark, target).collect())) == [("k1", "a"), ("k2", "b"), ("k3", "c")]
    keyed = spark.createDataFrame([(1, "k1"), (2, "k9")], "i int, key string")
    assert [r.i for r in store.misses(keyed, store.stored_results(spark, target)).collect()] == [2]


def test_hot_repository_is_ranked_by_many_tasks(spark):
    """A third of all issues and suggestions belongs to one repository, with ties and repeated rows."""
    levels = ["high", "medium", "low", None]
    rows = [("hot" if i % 3 == 0 else f"r{i % 50}", f"f{i % 700:04}", [(f"text {i % 211}", levels[i * 7 % 4], "why")]) for i in range(3000)]
    item = "array<struct<text:string,severity:string,reason:string>>"
    df = spark.createDataFrame(rows, f"repo_id string, path string, issues {item}").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart, as large ones do
    try:
        got = answers.merge_issues(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = got.where("repo_id = 'hot'").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 1000 and max(r["count"] for r in files) < 1000
    rank = {"high": 0, "medium": 1, "low": 2}
    for repo in ("hot", "r1", "r49"):
        own = sorted(((rank.get(x[0][1], 3), path, x[0][0]) for r, path, x in rows if r == repo))
        placed = sorted((r["nth"], rank.get(r["severity"], 3), r["file"], r["text"]) for r in got.where(F.col("repo_id") == repo).collect())
        assert [p[0] for p in placed] == list(range(1, len(own) + 1)) and sorted(p[1:] for p in placed) == own
        assert [p[1:3] for p in placed] == [o[:2] for o in own]
    few = answers.merge_issues(df, 3)
    assert few.where("repo_id = 'hot'").count() == 3 and few.agg(F.max("nth")).first()[0] == 3
    same = answers.merge_suggestions(df.withColumnRenamed("issues", "suggestions"))
    assert same.groupBy("repo_id").agg((F.max("nth") == F.count("*")).alias("ok"), F.countDistinct("text").alias("n"), F.count("*").alias("m")).where("NOT ok OR n <> m").count() == 0
    assert answers.merge_issues(df.limit(0)).count() == 0
