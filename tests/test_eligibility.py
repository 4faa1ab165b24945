from pyspark.sql import functions as F

from corpuslens.sources import corpus


def test_the_name_of_a_file_is_worked_out_once_per_use_of_its_content(spark):
    files = spark.createDataFrame([("r", "a.py", "x")], "repo_id string, path string, content string")
    read = corpus.from_table(files).where("content is not null").select(F.md5("content"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 4  # the filter and the digest, two tests of the extension each


def test_binary_blank_and_unlisted_files_have_no_content(spark):
    names = ["a.py", "b.png", "Dockerfile", "c.svg", "notes", ".gitignore", "d.PY", "e.PNG"]
    files = spark.createDataFrame([("r", n, "x") for n in names] + [("r", "blank.py", " \n"), ("r", "bin.py", "\x01\x02x"), ("r", "none.py", None)],
                                  "repo_id string, path string, content string")

    def read(**settings):
        return {r["path"] for r in corpus.from_table(files, **settings).where("content is not null").collect()}

    assert read() == {"a.py", "Dockerfile", ".gitignore", "d.PY"}
    assert read(extensions=[".svg", ".png", "notes"]) == {"Dockerfile", ".gitignore", "notes"}
    assert read(extensions=[]) == {"Dockerfile", ".gitignore"}
    assert read(extensions=corpus.ALL) == {"a.py", "Dockerfile", "notes", ".gitignore", "d.PY"}
    assert read(max_file_bytes=0) == set()
