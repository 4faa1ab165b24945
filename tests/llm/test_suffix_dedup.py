import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import suffix_dedup as sd


def repeated(texts, size):
    counts = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    return [np.array([counts[t[i : i + size]] > 1 for i in range(len(t) - size + 1)], bool) for t in texts]


def test_suffix_array_against_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        size, alphabet = rnd.choice([3, 8, 20, 60, 130]), rnd.choice([b"ab", b"abc \x00\xff", b"a"])
        base = bytes(rnd.choice(alphabet) for _ in range(400))
        texts = [base[(a := rnd.randint(0, 300)) : a + rnd.randint(0, 200)] + bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 6))]
        assert all((g == w).all() for g, w in zip(sd.equal_windows(texts, size), repeated(texts, size), strict=True))


def expected(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    for (doc_id, _), data, flags in zip(rows, texts, repeated(texts, size), strict=True):
        cover = np.zeros(len(data), bool)
        for at in np.flatnonzero(flags):
            cover[at : at + size] = True
        edges = sd.runs(cover)
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        yield doc_id, len(data), int(cover.sum()), len(spans), hashlib.sha256(sd.kept_bytes(data, spans)).hexdigest()


def got(docs, **settings):
    return Counter(tuple(r) for r in sd.repeated_spans(docs, **settings).drop("spans").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("settings", [{}, {"size": 60, "anchor": 20, "block_bytes": 2000}, {"size": 60, "anchor": 20, "group_limit": 1}])
def test_documents(sf001, settings):
    rows = [(r["doc_id"], r["text"]) for r in sf001.select("doc_id", "text").collect()]
    assert got(sf001, **settings) == Counter(expected(rows, settings.get("size", sd.SIZE)))


def test_edge_rows(edge_docs, edge_rows, no_docs):
    assert got(edge_docs) == Counter(expected(edge_rows, sd.SIZE))
    kept = sd.remove_repeats(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows) and kept.where("text is null").count() == 2
    assert sd.repeated_spans(no_docs).count() == 0 and sd.remove_repeats(no_docs).count() == 0


def test_texts_beyond_a_segment_are_whole(monkeypatch):
    rnd = random.Random(1)
    data = bytes(rnd.choice(b"abcdef") for _ in range(5000))
    monkeypatch.setattr(sd, "SEGMENT", 700)
    hashes, first, last = sd.contexts(data)
    assert first[0] == 0 and last[-1] == len(data) - sd.SIZE + 1 and (first[1:] == last[:-1]).all() and len(hashes) == len(first)


def test_characters_are_not_split(spark):
    passage = "漢字" * 100  # 600 bytes; a window may start within a character
    docs = spark.createDataFrame([(1, "é" + passage + "ü"), (2, passage + "tail")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in sd.remove_repeats(docs).collect()} == {1: "éü", 2: "tail"}
