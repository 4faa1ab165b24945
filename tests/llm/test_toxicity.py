import random
import zlib

from corpuslens.llm import toxicity


def test_labels_of_documents_locate_sentences(spark):
    rnd = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        sentences = [" ".join(f"w{rnd.randint(0, 300)}" for _ in range(8)) for _ in range(rnd.randint(1, 8))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            sentences[rnd.randrange(len(sentences))] += rnd.choice([" awful", " rottenest", " rottener", " rottening"])
        rows.append((i, ". ".join(sentences) + ".", 1 - toxic))
        marks.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    truth = dict(marks)
    scored = toxicity.scores(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    apart = [r for r in scored if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in apart) >= 0.95 * len(apart)
    model = toxicity.fit(docs, labels)
    texts = {i: t for i, t, _ in rows}
    located = [(texts[r["doc_id"]][s["start"] : s["end"]]) for r in toxicity.offending_sentences(docs, model).collect() for s in r["sentences"]]
    assert located and sum("awful" in x or "rotten" in x for x in located) >= 0.95 * len(located)


def test_held_out_accuracy_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.scores(docs, labels).where("held_out").join(labels, "doc_id").selectExpr("avg(cast(predicted = toxic as int))").first()[0]
    assert found >= 0.96


def test_edge_rows(edge_docs, edge_rows, no_docs, labels):
    for marks in (labels, labels.limit(0)):
        rows = toxicity.scores(edge_docs, marks).collect()
        assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
        same = [r["score"] for r in rows if r["doc_id"] in (6, 8)]
        assert len(set(same)) == 1
    assert toxicity.scores(no_docs, labels).count() == 0


def test_noisy_or():
    assert abs(toxicity.noisy_or([(0, 1, 0.5), (1, 2, 0.5)]) - 0.75) < 1e-12 and toxicity.sentences("") == [(0, 0)]
