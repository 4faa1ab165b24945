"""The pipeline against brute-force versions of its stages, each on its own input."""

from collections import Counter

import corpus_pipeline
from corpuslens.llm import pii, quality, suffix_dedup
from .test_jaccard_join import brute
from .test_packing import check
from .test_suffix_dedup import repeated

SF = "/root/testdata/sf0.001"


def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_stages(spark, sf001):
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    kept = stage["quality rules"](spark, sf001, SF).cache()
    judged = quality.quality_rules(sf001, spark.read.parquet(f"{SF}/labels.parquet")).where("kept")
    assert Counter(i for i, _ in rows(kept)) == Counter(r["doc_id"] for r in judged.collect())

    single = stage["n-gram Jaccard join"](spark, kept, SF).cache()
    groups = brute(rows(kept))
    assert sorted(i for i, _ in rows(single)) == sorted({g[3] for g in groups.values()})

    unrepeated = stage["suffix-array dedup"](spark, single, SF).cache()
    before = rows(single)
    expected = {}
    for (doc_id, text), flags in zip(before, repeated([t.encode() for _, t in before], suffix_dedup.SIZE), strict=True):
        data, cover = text.encode(), [False] * len(text.encode())
        for at in flags.nonzero()[0]:
            cover[at : at + suffix_dedup.SIZE] = [True] * suffix_dedup.SIZE
        expected[doc_id] = bytes(b for b, c in zip(data, cover, strict=True) if not c).decode("utf-8", errors="ignore")
    assert dict(rows(unrepeated)) == expected

    redacted = stage["personal data"](spark, unrepeated, SF).cache()
    assert len(rows(redacted)) == len(before) and not any(pii.base_spans(t) for _, t in rows(redacted))
    assert all(f.columns == sf001.columns for f in (kept, single, unrepeated, redacted))
    check(redacted, rows(redacted))


def test_edge_rows_and_empty_table(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, SF)
            made.count()
            if at < 4:
                assert made.columns == edge_docs.columns
