import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from corpuslens.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(turns)] for c, turns in own.items()}
    whole = own
    if rebuild:
        whole = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(node))))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(n) == len(node) + 1 for n in below), len(leaves),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def check(spark, rows, rebuild):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = pt.trie(df, rebuild)
    assert got.columns == COLUMNS
    order = lambda r: (r[1], r[0], r[7], r[3:7])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute(rows, rebuild), key=order)


def drawn(seed, n, ids, words=3):
    rnd = random.Random(seed)
    rows = []
    for c in ids(rnd, n):
        for t in range(rnd.randint(1, 8)):
            rows.append((c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "", None, "é😀"][:words])))
    return rows


@pytest.mark.parametrize("rebuild", [False, True])
def test_against_brute_force(spark, rebuild):
    check(spark, drawn(1, 60, lambda r, n: r.sample(range(400), n)), rebuild)
    # Many copies of one conversation, one with a third of all rows, proper prefixes, nulls.
    hot = [(7, t, "user", "xy") for t in range(150)] + [(8, t, "user", "xy") for t in range(70)] + [(7, None, None, None)] * 3
    copies = [(c, t, "user", f"t{t}") for c in range(200, 240) for t in range(3)] + [(300, 0, "user", "t0"), (None, 0, "user", "t0"), (None, None, None, None)]
    check(spark, hot + copies + drawn(2, 20, lambda r, n: range(20, 20 + n), 5), rebuild)


def test_edge_tables(spark):
    schema = "conv_id long, turn long, role string, text string, place string, depth string, high long, sequence string, leaf string, n_chars string"
    assert pt.trie(spark.createDataFrame([], schema), True).collect() == []
    rows = [(5, 1, "user", "a"), (100, 2, None, None), (101, None, "user", "")]
    clashing = spark.createDataFrame([(*r, "p", "d", 1, "s", "l", "n") for r in rows], schema)
    assert sorted(map(str, map(tuple, pt.trie(clashing, True).collect()))) == sorted(map(str, brute(rows, True)))


def test_sql_gives_the_same(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    expected = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({pt.TRIE_SQL})").fetchall()
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(str, expected)) == sorted(map(str, brute(rows, True)))
