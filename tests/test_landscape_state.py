import random
from collections import Counter

from corpuslens.operators.landscape_state import LandscapeState

ROWS = "repo_id string, category string, tech string"


def counted(state):
    return {(r["category"], r["tech"]): r["n_repos"] for r in state.counts().collect()}


def test_changes_equal_a_full_count(spark, tmp_path):
    rnd = random.Random(5)
    state, present = LandscapeState(spark, str(tmp_path / "state"), 4), {}
    assert counted(state) == {}
    for _ in range(4):
        names = [f"r{rnd.randint(0, 30)}" for _ in range(12)]
        change = {n: [(n, rnd.choice(["languages", "testing"]), rnd.choice(["a", "b", None])) for _ in range(rnd.randint(0, 3))] for n in names}
        rows = [row for n in change for row in change[n]]
        added, listed = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(n,) for n in [*names, names[0], None]], "repo_id string")
        state.apply(added, listed)
        state.apply(added, listed)  # again: nothing changes
        present.update(change)
        assert counted(state) == Counter((c, t) for rs in present.values() for _, c, t in rs)


def test_withdrawing_all_and_a_hot_repository(spark, tmp_path):
    state = LandscapeState(spark, str(tmp_path / "state"), 3)
    rows = spark.createDataFrame([("hot", "languages", f"t{i}") for i in range(300)] + [(f"r{i}", "languages", "t0") for i in range(50)], ROWS)
    state.apply(rows, rows.select("repo_id"))
    assert counted(state)["languages", "t0"] == 51 and state.contributions().where("n > 0").count() == 350
    state.apply(rows.limit(0), spark.createDataFrame([("hot",)], "repo_id string"))
    assert counted(state) == {("languages", "t0"): 50}
    untouched = spark.createDataFrame([("other", "languages", "x")], ROWS)  # not named as changed: left out
    state.apply(untouched, spark.createDataFrame([(f"r{i}",) for i in range(50)], "repo_id string"))
    assert counted(state) == {}
    state.apply(rows, rows.select("repo_id").limit(0))
    assert counted(state) == {}
