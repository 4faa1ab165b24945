import uuid

import pytest

from corpuslens.sources.sinks import SCHEMA, DocumentFolder


@pytest.fixture
def folder(spark, tmp_path):
    return DocumentFolder(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", 100)


def held(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def test_files_are_bounded_and_found_by_key(spark, folder):
    rows = [(f"r{i:03}", "x" * (i % 40)) for i in range(200)] + [("r007", "again"), (None, "none"), ("r500", None), ("", "long" * 100)]
    assert folder.version() == 0 and held(folder.documents()) == [] and held(folder.lookup(["r001"])) == []
    assert folder.write(spark.createDataFrame(rows, SCHEMA)) == 1
    assert held(folder.documents()) == sorted(rows, key=str)
    files = folder.files().collect()
    assert sum(f["rows"] for f in files) == len(rows) and len(files) > 30 and all(f["bytes"] <= 100 + 400 for f in files)
    assert held(folder.lookup(["r007", "r500", "", "absent"])) == sorted([("r007", "x" * 7), ("r007", "again"), ("r500", None), ("", "long" * 100)], key=str)


def test_failed_and_overtaken_writes_leave_what_was_there(spark, folder, monkeypatch):
    one, two = spark.createDataFrame([("a", "1")], SCHEMA), spark.createDataFrame([("b", "2")], SCHEMA)
    folder.write(one)
    with pytest.raises(Exception, match="broken"):
        folder.write(two.selectExpr("repo_id", "raise_error('broken') AS document"))
    assert folder.version() == 1 and held(folder.documents()) == [("a", "1")]
    monkeypatch.setattr(DocumentFolder, "version", lambda self: 0)  # as seen before another writer's commit
    with pytest.raises(RuntimeError, match="another writer"):
        folder.write(two)
    monkeypatch.undo()
    assert held(folder.documents()) == [("a", "1")]
    assert folder.write(two) == 2 and held(folder.documents()) == [("b", "2")] and held(folder.documents(1)) == [("a", "1")]
    assert folder.write(spark.createDataFrame([], SCHEMA)) == 3 and held(folder.documents()) == []
