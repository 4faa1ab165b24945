import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from corpuslens.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(turns, faults):
    """The cheapest, then ASCII-least edits: a search over (cost, initials) from the start, apart from any cost to the end."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, end = heapq.heappop(heap)
        if (at, end) in done:
            continue
        done.add((at, end))
        if at == len(turns) and end in ("", "a"):
            return cost, audit
        follow = "a" if end == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", at, follow))
        if at < len(turns):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, end))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, follow))
                initial = turns[at][0][:1]
                if (end, initial) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initial))


def repaired(turns, audit):
    out, at = [], 0
    for edit in audit:
        previous = out[-1][0][:1] if out else ""
        follow = "assistant" if previous == "u" else "user"
        if edit == "I":
            out.append((follow, ""))
            continue
        if edit != "D":
            out.append(turns[at] if edit == "K" else (follow, turns[at][1]))
        at += 1
    assert at == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return out


def report(rows, ids):
    """What ``reports`` gives for rows, and zeros for the other ids."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        convs[conv_id].append((turn is not None, turn or 0, key(role, text), role, text))
    out = {c: (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ids}
    for c, members in convs.items():
        members.sort()
        turns, numbers = [(m[3], m[4]) for m in members], [m[1] for m in members if m[0]]
        faults = faults_of(turns)
        cost, audit = best(turns, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        text = "\n".join(f"{r}:{t}" for r, t in repaired(turns, audit))
        out[c] = (c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return sorted(out.values(), key=str)


def drawn(rnd, conv_id, n):
    roles = ["user", "assistant", "system", "tool", "", "usher", None]
    texts = ["a.", "b!", "c", "  ", "", None, "d?\n", "e.\x0b x", "é漢😀."]
    return [(conv_id, rnd.choice([t, t, t + 3, None]), rnd.choice(roles), rnd.choice(texts) and rnd.choice([f"{t} ", ""]) + (rnd.choice(texts) or "")) for t in range(n)]


@pytest.mark.parametrize("block_rows", [1, 3, 1024])
def test_reports_against_a_search(spark, block_rows):
    rnd = random.Random(block_rows)
    rows = [r for c in [*range(40), None] for r in drawn(rnd, c, rnd.randint(1, 12))] + drawn(rnd, 99, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted(map(tuple, cr.reports(df, block_rows).collect()), key=str) == report(plain, [])


def test_damage_and_repair(spark):
    rnd = random.Random(8)
    rows = [r for c in [*range(200), None] for r in drawn(rnd, c, rnd.randint(1, 6))]
    rows.append((next(c for c in range(300, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "a."))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = cr.damage_and_repair(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == report(damaged(rows), {r[0] for r in rows}) and any(not g[7] for g in got)


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, cr.damage_and_repair(df).collect()), key=str) == report(damaged(rows), {r[0] for r in rows})


def test_repaired_turns_and_edge_tables(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "x."), (1, 2, "assistant", "y."), (2, None, None, None), (None, 5, "user", "q."), (3, 4, "user", "same."), (3, 4, "user", "same.")]
    clashing = spark.createDataFrame([(*r, "k", "c", 1, "b") for r in rows], SCHEMA + ", key string, code string, seq long, audit string")
    found = defaultdict(list)
    for r in sorted(cr.repaired_turns(clashing).collect(), key=lambda r: r["turn"]):
        found[r["conv_id"]].append((r["role"], r["text"]))
    for c in {r[0] for r in rows}:
        turns = sorted(((" " if r is None else r, " " if x is None else x) for i, _, r, x in rows if i == c), key=lambda p: (p[1] != "s.", key(*p)) if c != 1 else p[1])
        assert found.get(c, []) == repaired(turns, best(turns, faults_of(turns))[1])
    assert cr.damage_and_repair(spark.createDataFrame([], SCHEMA)).collect() == []
    long_text = spark.createDataFrame([(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "a" * 1_500_000)], SCHEMA)
    assert cr.reports(long_text).first()["audit"] == "KK"


def test_codes_are_walked_block_by_block():
    rnd = random.Random(2)
    for n in (0, 1, 2, 5, 17, 300):
        codes = bytes(rnd.randrange(16) for _ in range(n))
        whole, state = cr.tight_edits(codes, cr.END, 0, True)
        for at in range(0, n, 7):
            middle = cr._back(codes[at:], cr.END, lambda i: i == 0)[0]
            left, between = cr.tight_edits(codes[:at], middle, 0, False)
            right, last = cr.tight_edits(codes[at:], cr.END, between, True)
            assert (left + right, last) == (whole, state)
            if at:
                assert tuple((cr.block_matrix(codes[:at]) + middle).min(axis=1)) == cr._back(codes, cr.END, lambda i: i == 0)[0]
