import random
from collections import Counter, defaultdict

from corpuslens.llm import jaccard_join as jj


def brute(rows, similarity=0.8):
    """Per text: least id, copies, links, least id of the group."""
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[text or ""].append(doc_id)
    sets = {}
    for text in classes:
        words = text.lower().split()
        size = min(5, len(words))
        sets[text] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    texts = list(classes)
    links, group = Counter(), {t: t for t in texts}

    def top(t):
        while group[t] != t:
            t = group[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                links.update([a, b])
                group[top(a)] = top(b)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    members = defaultdict(list)
    for t in texts:
        members[top(t)] += classes[t]
    return {t: (least(classes[t]), len(classes[t]), links[t], least(members[top(t)])) for t in texts}


def check(docs, rows, **settings):
    expected = brute(rows)
    got = Counter(tuple(r) for r in jj.jaccard_join(docs, **settings).collect())
    assert got == Counter((i, *expected[t or ""]) for i, t in rows)


def near_copies(n=120, seed=5):
    rnd = random.Random(seed)
    rows, base = [], [[f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(3, 150))] for _ in range(12)]
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_copies_against_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows)
    check(docs, rows, node_part=3, block=4)  # large nodes and groups, split


def test_edges_grow_with_the_members_of_a_group(spark, monkeypatch):
    """Edits of one template, all linked: edges for the second components are at most two per member at three sizes."""
    counted = []
    plain = jj.components

    def counting(edges):
        counted.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(jj, "components", counting)
    for n in (100, 200, 400):
        words = [f"w{i}" for i in range(120)]
        rows = [(i, " ".join([*words[:60], f"own{i}", *words[61:]])) for i in range(n)]
        got = jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16)
        assert {tuple(r)[1:] for r in got.collect()} == {(i, 1, n - 1, 0) for i in range(n)} and counted[-1] <= 2 * n


def test_edge_rows(edge_docs, edge_rows, no_docs):
    check(edge_docs, edge_rows)
    kept = jj.keep_one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    expected = brute(edge_rows)
    groups = Counter((r["doc_id"], r["text"] or "") for r in kept.select("doc_id", "text").collect())
    assert max(groups.values()) == 1 and sum(groups.values()) == len({(expected[t][3], t if expected[t][2] == 0 else "") for t in expected})
    assert jj.jaccard_join(no_docs).count() == 0 and jj.keep_one_per_group(no_docs).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_prefixes_shorten_to_the_recall():
    assert jj.prefix_length(0.8, 0.999, 24, 8) == 6 and jj.prefix_length(0.95, 0.999, 24, 8) == 8 and jj.prefix_length(0.3, 0.999, 24, 8) == 1
