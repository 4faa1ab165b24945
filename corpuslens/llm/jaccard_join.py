"""N-gram Jaccard join: a MinHash LSH forest proposes, exact comparison of shingle sets decides.

Equal texts form a class and are joined once, by one of them.  Words are what white space separates, in
lower case; a shingle is five words in a row (a text of fewer words is one shingle), held as a 64-bit hash.

1. Every class has ``TREES`` labels of ``DEPTH`` MinHash values, the leaves of prefix tries; two classes meet in a
   tree if their labels share a prefix.  All prefixes have the same length, the longest at which two sets at
   the least similarity meet in some tree with probability ``RECALL`` (``prefix_length``): banding, in effect.
2. Classes under one trie node may be very many (a third of all rows may be near copies), so that a
   node's members are not paired: they are compared with a few *leaders*, by an estimate from their
   MinHash values, and leaders only with members that are not connected to them yet: a node gives fewer
   edges than it has members.  A large node is split at random; there, leaders go on until every member
   is close to one, and the parts' leaders meet once more.  Jaccard distance obeys the triangle
   inequality, so that two similar members have leaders that are linked, with slack for the estimate's
   error.
3. Connected members form a candidate group.  Groups are cut into blocks.  Each block is compared exactly, as
   a product of membership matrices in one task, which gives counts of links and the block's connected parts;
   then every pair of blocks of a group, which gives counts and edges between parts: each pair of a group is
   compared once, without a row per pair, and edges stay fewer than texts.

Expected recall of links at the least similarity: ``RECALL`` or more; above it, higher.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import add_columns, once_per_process, written
from corpuslens.llm.graphs import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
TREES = 24
DEPTH = 8
ESTIMATE_PER_TREE = 4  # MinHash values of each tree that estimates use
CLOSE = 0.85  # estimate from which a member needs no leader of its own
NEAR = 0.35  # estimate from which a member and a leader are connected
NODE_PART = 20000
BLOCK = 512
CACHED_WORDS = 1 << 16


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which two sets of this similarity meet in one of the trees with this probability."""
    length = depth
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def _word_hashes(words: list[str]) -> np.ndarray:
    known = once_per_process(("word-hashes",), dict)
    if len(known) > CACHED_WORDS:
        known.clear()
    found = []
    for word in words:
        h = known.get(word)
        if h is None:
            h = known[word] = xxhash.xxh3_64_intdigest(word)
        found.append(h)
    return np.array(found, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes, size = _word_hashes(words), min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(total)


def signature(sets: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """MinHash values, a row per tree."""
    seeds = once_per_process(("seeds", trees, depth), lambda: np.random.default_rng(5).integers(1, 1 << 63, (2, trees * depth), np.uint64) * np.uint64(2) + np.uint64(1))
    least = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 1024):
        values = sets[None, at : at + 1024] * seeds[0][:, None] + seeds[1][:, None]
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, values.min(axis=1))
    return _mixed(least).reshape(trees, depth)


def node_names(label_rows: np.ndarray, length: int) -> np.ndarray:
    """One 64-bit name per tree of the trie node at a prefix."""
    name = np.arange(1, len(label_rows) + 1, dtype=np.uint64)
    for i in range(length):
        name = _mixed(name * np.uint64(0x9E3779B97F4A7C15) + label_rows[:, i])
    return name.astype(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows sorted by their first columns."""
    last, rows = None, []
    parts = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))  # few texts as Python strings
    for part in parts:
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[:n_keys] != last:
                if rows:
                    yield last, rows
                last, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield last, rows


def _connected(keys: list[bytes], sketches: np.ndarray, cover: bool) -> Iterator[tuple[int, int | None]]:
    """(member, leader) edges that connect the similar members of a trie node, at most one less than members.

    Leaders are compared with the members that are not yet connected to them.  With ``cover``, leaders go
    on until every member is close to one, and (leader, None) names them.
    """
    part, waiting = np.arange(len(keys)), np.ones(len(keys), bool)
    while waiting.any():
        leader = int(np.argmax(waiting))
        others = np.flatnonzero(waiting if cover else part != part[leader])
        waiting[leader] = False
        if cover:
            yield leader, None
        elif not len(others):
            return
        alike = (sketches[others] == sketches[leader]).mean(axis=1)
        waiting[others[alike >= CLOSE]] = False
        for member in others[alike >= NEAR]:
            if part[member] != part[leader]:
                part[part == part[member]] = part[leader]
                yield int(member), leader


def _leaders(groups: Iterator[tuple[tuple, list[tuple]]]) -> Iterator[tuple]:
    """(node, key, leader, sketch of a leader whose node has other parts) of the members of every trie node."""
    for (node, _), members in groups:
        keys, sketches = [m[0] for m in members], np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(len(members), -1)
        for member, leader in _connected(keys, sketches, bool(members[0][2])):
            yield (node, keys[member], keys[member], members[member][1]) if leader is None else (node, keys[member], keys[leader], None)


def _edges(members: DataFrame) -> DataFrame:
    """(node, key, leader, sketch) from (node, part, key, sketch, split)."""
    schema = "node long, key binary, leader binary, sketch binary"
    arrow = pa.schema([("node", pa.int64()), ("key", pa.binary()), ("leader", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        rows: list[tuple] = []
        for row in _leaders(_sorted_groups(batches, 2)):
            rows.append(row)
            if len(rows) >= 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return members.repartition("node", "part").sortWithinPartitions("node", "part", "key").mapInArrow(run, schema)


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Matrix of pairs with at least this Jaccard similarity; within ``left`` if ``right`` is None."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column, width, n = row[order], column[order], int(shared.sum()), len(left)
    common = np.zeros((n, len(right) if right is not None else n), np.float32)
    for at in range(0, width, 8192):
        lo, hi = np.searchsorted(column, [at, at + 8192])
        block = np.zeros((len(sets), min(8192, width - at)), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        common += block[:n] @ (block[n:] if right is not None else block).T
    whole = sizes[:n, None] + (sizes[n:] if right is not None else sizes)[None, :] - common
    linked = common >= similarity * whole - 1e-6
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first one that links connect it with."""
    label, unseen = np.arange(len(linked)), np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not unseen[root]:
            continue
        unseen[root], stack = False, [root]
        while stack:
            found = np.flatnonzero(linked[stack.pop()] & unseen)
            unseen[found] = False
            label[found] = root
            stack += found.tolist()
    return label


def _spanning(pairs: set[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs that connect the same names as all of them do, at most one less than names."""
    top: dict[bytes, bytes] = {}

    def find(name: bytes) -> bytes:
        while top.setdefault(name, name) != name:
            top[name] = top[top[name]]
            name = top[name]
        return name

    for a, b in sorted(pairs):
        x, y = find(a), find(b)
        if x != y:
            top[x] = y
            yield a, b


def _within(similarity: float, size: int) -> Callable:
    """(key, links, other) of blocks: how many others of its block a text is linked to, and the block's first text it is connected with."""
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _sorted_groups(batches, 2):
            linked = links_between([shingles(text, size) for _, text in rows], None, similarity) if len(rows) > 1 else np.zeros((1, 1), bool)
            counts, labels = linked.sum(axis=1), _labels(linked)
            out = [(rows[i][0], int(counts[i]), rows[labels[i]][0]) for i in np.flatnonzero(counts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _across(similarity: float, size: int) -> Callable:
    """(key, links, other) of pairs of blocks: links between them, and edges between their connected parts.

    Parts of a block are known by their first text: however many links there are, parts are joined by fewer edges
    than there are parts.
    """
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, _), rows in _sorted_groups(batches, 3):
            left, right = [r for r in rows if r[0] == low], [r for r in rows if r[0] != low]
            if not left or not right:
                continue
            linked = links_between([shingles(r[2], size) for r in left], [shingles(r[2], size) for r in right], similarity)
            out = [(side[i][1], int(counts[i]), None) for side, counts in ((left, linked.sum(axis=1)), (right, linked.sum(axis=0))) for i in np.flatnonzero(counts)]
            pairs = {(left[i][3], right[j][3]) for i, j in np.argwhere(linked)}
            out += [(a, 0, b) for a, b in _spanning(pairs)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def verified_links(texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(key, links, other) of candidate groups: counts of links to sum up, and edges that connect what links connect.

    ``texts``: (component, blocks, key, text), a row per text.  First each block by itself, then every pair
    of blocks of groups that have several.  Edges are fewer than texts and, for pairs, than the blocks' connected parts.
    """
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    held = texts.select("component", "blocks", own.alias("own"), "key", "text")
    schema = "key binary, links long, other binary"
    single = held.select("component", "own", "key", "text").repartition("component", "own").sortWithinPartitions("component", "own")
    within = written(single.mapInArrow(_within(similarity, size), schema), "within")

    several = held.where("blocks > 1").join(within.select("key", F.col("other").alias("label")), "key", "left").withColumn("label", F.coalesce("label", "key"))
    met = several.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != own")
    pairs = met.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key", "text", "label")
    pairs = pairs.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
    return within.unionByName(written(pairs.mapInArrow(_across(similarity, size), schema), "across"))


def classes_and_links(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS, recall: float = RECALL, node_part: int = NODE_PART, block: int = BLOCK) -> DataFrame:
    """(key, class_id, n_copies, n_links, group_id), a row per different text of ``docs`` (doc_id, text).

    class_id: the least doc_id among equal texts (null if all are null); n_links: how many different texts
    are linked to it; group_id: the least class_id of those that links connect.
    """
    length = prefix_length(similarity, recall)

    def start():
        def sign(texts: list[str]) -> list[list]:
            out: list[list] = [[], []]
            for text in texts:
                own = shingles(text, size)
                label = signature(own) if len(own) else None
                out[0].append([] if label is None else node_names(label, length).tolist())
                out[1].append(b"" if label is None else label[:, :ESTIMATE_PER_TREE].astype(np.uint8).tobytes())
            return out

        return sign

    signed = add_columns(_keyed(docs.select("doc_id", "text")), "nodes array<bigint>, sketch binary", start, ["doc_id", "key"])
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.max("nodes").alias("nodes"), F.max("sketch").alias("sketch"))
    classes = written(classes, "classes")

    nodes = classes.select("key", F.explode("nodes").alias("node"))
    met = nodes.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
    members = nodes.join(met, "node").join(classes.select("key", "sketch"), "key")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("members") / node_part)).cast("int")
    led = written(_edges(members.select("node", part.alias("part"), "key", "sketch", (F.col("members") > node_part).alias("split"))), "led")
    again = _edges(led.where("sketch is not null").select("node", F.lit(0).alias("part"), "key", "sketch", F.lit(False).alias("split")))
    edges = led.where("sketch is null").select("key", "leader").unionByName(again.select("key", "leader"))
    groups = written(components(edges.select(F.col("key").alias("a"), F.col("leader").alias("b"))), "groups")

    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = groups.join(sizes, "component").join(classes.select(F.col("key").alias("node"), "class_id"), "node")
    placed = placed.select(F.col("node").alias("key"), "component", "blocks", "class_id")
    texts = _keyed(docs.select(F.col("doc_id").alias("own_id"), "text"))
    texts = texts.join(placed, "key").where(F.col("own_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["key"])
    found = verified_links(texts, similarity, size)

    linked = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    joined = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    numbered = classes.join(joined.withColumnRenamed("node", "key"), "key", "left").join(linked, "key", "left")
    least = numbered.where("component is not null").groupBy("component").agg(F.min("class_id").alias("least"))
    numbered = numbered.join(least, "component", "left")
    return numbered.select(
        "key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "class_id").alias("group_id"),
        F.coalesce("component", "key").alias("group_key"),
    )


def jaccard_join(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, group_id) of every document.

    Null and empty texts have no shingles and no links, and are copies of each other; repeated rows are
    copies.  Texts that differ only in white space or case are different texts with similarity 1.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    classes = written(classes_and_links(rows, **settings), "classes")
    return _keyed(rows).select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "n_copies", "n_links", "group_id")


def keep_one_per_group(docs: DataFrame, **settings) -> DataFrame:
    """The documents, all columns kept, without those whose group has one with a smaller doc_id.

    Of rows that agree in doc_id and text one stays; a null doc_id comes after all others.
    """
    names = docs.columns
    inner = docs.select(*[docs[c].alias(c if c in ("doc_id", "text") else f"own_{i}") for i, c in enumerate(names)])
    classes = written(classes_and_links(inner.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), **settings), "classes")
    best = classes.groupBy("group_key").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "key")).alias("best"))
    best = written(best.select(F.col("best.key").alias("key"), F.col("best.class_id").alias("kept_id")), "kept")
    kept = _keyed(inner).join(best, "key").where(F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")))
    kept = kept.dropDuplicates(["key"]).select(*inner.columns)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(inner.columns, names, strict=True)])
