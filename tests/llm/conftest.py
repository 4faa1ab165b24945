import pytest

CLASHING = [
    "key", "node", "component", "score", "kept", "block", "anchors", "anchor", "marks", "text_key", "spans", "counts", "base", "place", "shard", "id", "rows",
    "class_id", "digest", "n_bytes", "own_0", "toxic", "anomaly", "n_words", "start", "ids", "hash", "part", "next_text",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, equal ids with other texts, clashing names."""
    long_text = "abcdefghij" * 3000
    words = " ".join(f"word{i}" for i in range(3000))
    rows = [
        (1, "a plain text of a few words here. And one more sentence follows it.\nWith a second line", "en"), (2, None, "en"), (3, "", None), (None, "no id at all", "en"),
        (None, None, None), (4, long_text, "en"), (5, words, "en"), (6, "same row", "en"), (6, "same row", "en"), (7, "first of an id", "en"), (7, "second of an id", "de"),
        (8, "same row", "fr"), (9, "ünï çödé 漢字 😀 \x00 end", "xx"), (10, " \n\t ", "en"), (11, words + " tail", "en"), (12, "one", "en"),
    ]
    values = [(i, t, g, None if t is None else "s", None, *([f"c{n}"] * len(CLASHING))) for n, (i, t, g) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(values, schema).repartition(3)


@pytest.fixture(scope="session")
def edge_rows(edge_docs):
    return [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sf001(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
