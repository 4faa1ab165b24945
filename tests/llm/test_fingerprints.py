import hashlib
import re

from pyspark.sql import functions as F

from corpuslens.llm import fingerprints as fp


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(text):
    sections, run = [], []
    for digest in map(sha, text.split("\n")):
        run.append(digest + ",")
        if digest[0] == "0":
            sections.append(sha("".join(run)))
            run = []
    return sha(",".join(sections + ([sha("".join(run))] if run else [])))


def likeness(a, b):
    left, right = set(re.findall(fp.PIECE, a)), set(re.findall(fp.PIECE, b))
    larger = max(sum(map(len, left)), sum(map(len, right)))
    return sum(map(len, left & right)) / larger if larger else 1.0


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    for at, (doc_id, text) in enumerate(ordered):
        text, other = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        yield doc_id, len(text), sha(edited), root(text), root(edited), round(likeness(text, edited), 9), round(likeness(text, other), 9)


def key(row):
    return tuple(str(x) for x in row)


def result(docs):
    rows = fp.fingerprint_edits(docs).collect()
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in rows), key=key)


def test_edge_rows_and_ties(edge_docs, edge_rows, no_docs):
    assert result(edge_docs) == sorted(expected(edge_rows), key=key)
    assert result(no_docs) == []


def test_documents(spark, sf001):
    rows = [(r["doc_id"], r["text"]) for r in sf001.collect()]
    spread = [(i * 1000003, t) for i, t in rows]  # gaps over many blocks and ranges
    assert result(spark.createDataFrame(spread, "doc_id long, text string")) == sorted(expected(spread), key=key)


def least_edits(left, right):
    """Paragraphs to take out of both texts at least, by dynamic programming."""
    a, b = left.split("\n"), right.split("\n")
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last if x == y else 1 + min(row[j], row[j + 1])
    return row[-1]


def located(spark, pairs):
    docs = spark.createDataFrame([(i, *p, "extra") for i, p in enumerate(pairs)], "id long, one string, two string, key string")
    return {r["id"]: (r["removed"], r["inserted"]) for r in fp.locate_edits(docs, "id", "one", "two").collect()}


def without(text, places):
    return [p for i, p in enumerate((text or "").split("\n")) if i not in set(places)]


def test_edits_are_located(spark):
    paragraphs = [f"paragraph {i} with words" for i in range(60)]
    text = "\n".join
    edited = lambda *changes: text([dict(changes).get(i, p) for i, p in enumerate(paragraphs)])
    moved = [*paragraphs[:5], *paragraphs[6:50], paragraphs[5], *paragraphs[50:]]
    twice = [*paragraphs[:40], paragraphs[3], *paragraphs[40:]]
    cases = [
        (text(paragraphs), edited((7, "x"), (31, "y")), [7, 31], [7, 31]),
        (text(paragraphs), text([*paragraphs[:20], "new", *paragraphs[20:]]), [], [20]),
        (text(paragraphs), text([*paragraphs, "last"]), [], [60]),
        (text(paragraphs), text(paragraphs[:33] + paragraphs[34:]), [33], []),
        (text(paragraphs), text(moved), [5], [49]),
        (text(twice), text(paragraphs), [40], []),
        (text(twice), text(twice[:3] + twice[4:]), [3], []),
        (text(paragraphs), text(paragraphs), [], []),
        (None, "", [], []),
        (None, "one", [0], [0]),
    ]
    found = located(spark, [c[:2] for c in cases])
    assert [found[i] for i in range(len(cases))] == [(removed, inserted) for _, _, removed, inserted in cases]


def test_located_edits_leave_the_same_paragraphs(spark):
    import random

    draw = random.Random(5)
    pairs = []
    for _ in range(60):
        left = [f"p{draw.randrange(30)}" for _ in range(draw.randrange(1, 80))]
        right = list(left)
        for _ in range(draw.randrange(1, 5)):
            at, to = draw.randrange(len(right)), draw.randrange(len(right))
            change = draw.randrange(4)
            if change == 0:
                right.insert(at, f"q{to}")
            elif change == 1 and len(right) > 1:
                del right[at]
            elif change == 2:
                right.insert(to, right.pop(at))
            else:
                right.insert(to, right[at])
        pairs.append(("\n".join(left), "\n".join(right)))
    found = located(spark, pairs)
    named = fewest = 0
    for i, (left, right) in enumerate(pairs):
        removed, inserted = found[i]
        assert without(left, removed) == without(right, inserted)
        named, fewest = named + len(removed) + len(inserted), fewest + least_edits(left, right)
    assert fewest <= named <= 2 * fewest


def test_edits_of_no_pairs(spark):
    assert located(spark, []) == {}
