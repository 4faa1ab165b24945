import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslens.operators.running import running


def brute(rows):
    out, groups = {}, defaultdict(list)
    for group, at, value in rows:
        groups[group].append((at, value))
    for group, members in groups.items():
        total = mixed = 0
        for place, (at, value) in enumerate(sorted(members), 1):
            total += value or 0
            mixed ^= value or 0
            out[group, at] = (place, (total + 2**63) % 2**64 - 2**63, mixed)
    return out


@pytest.mark.parametrize("largest", [50, 2**62])
def test_hot_groups_across_tasks(spark, largest):
    rnd = random.Random(largest)
    rows = [(rnd.choice(["a", "a", "a", None, "b", f"g{i % 40}"]), i, rnd.choice([None, rnd.randint(-largest, largest)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    got = running(df, ["g"], ["i"], sums={"s": "v"}, xors={"x": "v"})
    assert {(r["g"], r["i"]): (r["position"], r["s"], r["x"]) for r in got.collect()} == brute(rows)
    assert got.count() == len(rows) and got.columns == ["g", "i", "v", "position", "s", "x"]


def test_one_group_descending_ties_and_empty(spark):
    rows = [(i % 7, i) for i in range(500)]
    df = spark.createDataFrame(rows, "v long, i long")
    got = running(df, [], [F.desc("i")], sums={"s": "v"})
    assert sorted((r["position"], r["i"]) for r in got.collect()) == [(p, 500 - p) for p in range(1, 501)]
    assert got.agg(F.max("s")).first()[0] == sum(v for v, _ in rows)
    same = spark.createDataFrame([("k", 1)] * 90, "g string, i long")
    assert sorted(r["position"] for r in running(same, ["g"], ["i"]).collect()) == list(range(1, 91))
    assert running(df.limit(0), ["v"], ["i"]).count() == 0
