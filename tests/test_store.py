import uuid

import pytest

from corpuslens.sources.store import ResultStore

SCHEMA = "key string, result string"


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(store, version=None):
    return sorted(map(tuple, store.rows(version).collect()))


def test_appends_lookups_and_versions(spark, store):
    assert store.version() == 0 and held(store) == [] and store.lookup(["aa1"]).collect() == []
    assert store.append(frame(spark, ("aa1", "x"), ("ab2", "y"), ("aa1", "w"), (None, "n"))) == 1
    assert store.append(frame(spark, ("aa1", "later"), ("ab2", "later"))) == 1  # nothing new
    assert store.append(frame(spark, ("aa1", "later"), ("b", None), ("", "short"))) == 2
    assert held(store) == [("", "short"), ("aa1", "w"), ("ab2", "y"), ("b", None)] and held(store, 1) == [("aa1", "w"), ("ab2", "y")]
    assert sorted(map(tuple, store.lookup(["aa1", "b", "zz", ""]).collect())) == [("", "short"), ("aa1", "w"), ("b", None)]
    asked = spark.createDataFrame([(1, "aa1"), (2, "zz"), (3, None), (4, "aa1")], "i int, key string")
    assert sorted((r.i, r.result) for r in store.with_results(asked).collect()) == [(1, "w"), (2, None), (3, None), (4, "w")]
    assert sorted(r.i for r in store.misses(asked).collect()) == [2, 3]
    assert store.compact() == 3 and len(store.parts()) == 1 and held(store) == held(store, 2)


def test_a_lookup_opens_the_buckets_of_its_keys(spark, store):
    store.append(frame(spark, *((f"{i:02x}k", str(i)) for i in range(40))))
    files = store.lookup(["03k", "11k"]).inputFiles()
    plan = store.lookup(["03k"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(key), EqualTo(key,03k)]" in plan and len(files) >= 2


def test_two_writers_store_a_key_once(spark, store):
    """The second writer commits between the first one's writing and its commit."""
    store.append(frame(spark, ("aa", "old")))
    other = ResultStore(spark, store.location)
    create, done = store._committed, []

    def late(version, parts):
        if not done:
            done.append(other.append(frame(spark, ("bb", "theirs"), ("cc", "theirs"))))
        return create(version, parts)

    store._committed = late
    assert store.append(frame(spark, ("aa", "mine"), ("bb", "mine"), ("dd", "mine"))) == 3
    assert held(store) == [("aa", "old"), ("bb", "theirs"), ("cc", "theirs"), ("dd", "mine")]
    done.clear()
    assert store.append(frame(spark, ("bb", "again"), ("ee", "mine"))) == 4  # the other writer had nothing new
    assert held(store)[-1] == ("ee", "mine")


def test_an_append_that_dies_leaves_the_store_as_it_was(spark, store):
    store.append(frame(spark, ("aa", "old")))
    store._write(frame(spark, ("bb", "lost")))  # a part without a manifest
    assert held(store) == [("aa", "old")] and store.version() == 1
