import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import pii


def brute(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            spans.append(("card", *m.span()))
    return spans + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_against_plain_patterns(sf001):
    rnd = random.Random(4)
    parts = ["a", "b.c", "@", ".", "1", "25", "300", "0", "-", " ", "+", "(", ")", "4111111111111111", "é", "x@y.z", "+1 (017) 555-7713", "1.2.3.4", "_%"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for text in made + [r["text"] for r in sf001.collect()]:
        assert pii.base_spans(text) == brute(text)


def test_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    trees = pii.boosted_trees(x[:1500], y[:1500])
    scores = trees.scores(x[1500:])
    assert ((scores > 0.5) == y[1500:]).mean() > 0.97
    limit = pii.threshold(scores, y[1500:])
    assert limit is not None and y[1500:][scores >= limit].mean() >= pii.PRECISION
    assert pii.threshold(np.array([0.9] * 30), np.array([0.0] * 30)) is None


def test_edge_rows_and_redaction(spark, edge_docs, edge_rows, no_docs):
    rows = pii.find_personal_data(edge_docs).collect()
    assert sorted((str(r["doc_id"]), r["base"]) for r in rows) == sorted((str(i), pii.joined(brute(t or ""))) for i, t in edge_rows)
    clean = pii.redact(edge_docs)
    assert clean.columns == edge_docs.columns and clean.count() == len(edge_rows) and clean.where("text is null").count() == 2
    assert pii.find_personal_data(no_docs).count() == 0 and pii.redact(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "mail a.b@example.com or +1 (017) 555-7713, card 4111 1111 1111 1111 at 10.0.0.7."), (2, "nothing 12 here")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["mail [email] or [phone], card [card] at [ip].", "nothing 12 here"]


PLANTED = {
    "mail_like": ["jane.doe at example dot com", "jane.doe [at] example [dot] com", "k.miller77(at)mail3.example.org", "bob_smith[at]shop(dot)example(dot)net"],
    "dotted_like": ["10[.]20[.]30[.]44", "192 dot 168 dot 7 dot 21"],
    "digits_like": ["0171-5557713", "0345 555 8841"],
}
KEPT = ["look at this.Then go on", "aim at noon dot and go", "on 01.02.2024 there", "since 2019-11-05 it ran", "300[.]411[.]20[.]7", "in 1998 and 2004", "number 7036638319846192"]


def test_planted_forms_are_found_and_clean_text_kept(spark):
    """Recall of masked forms per kind, and precision on text without personal data, both planted in unseen documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.fit(docs)
    assert set(model.thresholds) == set(pii.GENERATED)
    texts = [r["text"] for r in docs.where("doc_id % 50 = 7").select("text").collect() if r["text"] and not pii.base_spans(r["text"]) and " " in r["text"]][:60]
    for kind, forms in PLANTED.items():
        hits = 0
        for i, text in enumerate(texts):
            form = forms[i % len(forms)]
            at = text.index(" ", len(text) // 3) if " " in text[len(text) // 3 :] else text.index(" ")
            planted = f"{text[:at]} {form} {text[at + 1 :]}"
            hits += (kind, at + 1, at + 1 + len(form)) in model.selected(planted, pii.base_spans(planted))
        assert hits >= 0.9 * len(texts), (kind, hits, len(texts))
    for text in texts:
        assert model.selected(text, []) == []
        for form in KEPT:
            planted = f"{text[:200]} {form} {text[200:400]}"
            assert model.selected(planted, pii.base_spans(planted)) == [], form


def test_added_spans_come_from_the_trees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = pii.find_personal_data(docs).where("spans <> base").collect()
    assert rows  # chains of numbers that the base patterns drop as a whole
    assert all(set(r["base"].split(",")) - {""} <= set(r["spans"].split(",")) for r in rows)


def test_small_tables_teach_little_and_crash_nothing(spark):
    docs = spark.createDataFrame([(1, "a@b.co"), (2, "1.2.3.4"), (3, "+49 171 5557713"), (4, ""), (5, None)], "doc_id long, text string")
    model = pii.fit(docs)
    assert model.thresholds == {} and model.selected("jane at example dot com", []) == []
    assert len(pii.teaching_rows("see you now a@b.co")) == 25 and pii.teaching_rows("jane at example dot com") == []


def test_every_candidate_teaches_and_counts(spark, monkeypatch):
    """Rows beyond any sample decide: the few good ones among many copies of a text without personal data."""
    texts = [f"call me at +{1 + i % 9} (0{i % 90 + 10}) 555-{1000 + 7 * i} or write to user{i}@host{i % 7}.example.com today" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many = docs.unionByName(spark.range(40_000).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("paid on 12.03.2021 for order 1234567 "), F.lit("in full")).alias("text")))
    monkeypatch.setattr(pii, "TREES", pii.TREES_AT_ONCE + 2)
    one, other = pii.fit(many), pii.fit(many, cells_at_once=0)
    n = sum(len(pii.teaching_rows(t)) for t in texts)
    assert len(pii.teaching_rows("paid on 12.03.2021 for order 1234567 in full")) > 0 and n < 40_000
    own = [r for t in texts for r in pii.teaching_rows(t)] + 40_000 * pii.teaching_rows("paid on 12.03.2021 for order 1234567 in full")
    for kind, trees in one.trees.items():
        taught = [r for r in own if r[0] == kind and not r[2]]
        x, y = np.array([r[3] for r in taught], float), np.array([r[1] for r in taught], float)
        plain = pii.boosted_trees(x, y)
        for found in (trees, other.trees[kind]):  # in memory and by jobs
            assert found.start == plain.start and np.array_equal(found.nodes, plain.nodes) and np.array_equal(found.leaves, plain.leaves)
    assert one.thresholds == other.thresholds and set(one.trees) == set(other.trees)
