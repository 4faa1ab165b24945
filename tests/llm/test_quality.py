import random
import re
from collections import Counter

from corpuslens.llm import quality


def brute_repeats(words, size=8):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(size)})


def test_statistics_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(["a ", "b ", "c# ", "\n", "é x ", "\x0b", " \n", "dd$ "]) for _ in range(rnd.randint(0, 120)))
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        got = dict(zip(quality.COUNTS, quality.statistics(text), strict=True))
        lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0b\x0c\x0d")]
        assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
        assert got["n_repeat_words"] == brute_repeats(words)


def test_edge_rows(spark, edge_docs, edge_rows, labels, no_docs):
    rows = quality.quality_rules(edge_docs, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in edge_rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    kept = quality.keep_good(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.quality_rules(no_docs, labels).count() == 0 and quality.keep_good(no_docs, labels.limit(0)).count() == 0


def test_thresholds_separate_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in judged}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))
    unlabelled = quality.quality_rules(docs, labels.limit(0))
    assert unlabelled.where("kept = base_failed").count() == 0  # nothing but the base rules rejects
