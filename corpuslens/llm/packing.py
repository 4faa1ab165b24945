"""Lexical retrieval packing: windows of documents that share words, cut without padding.

1. Texts are encoded once; ids are written to the shared folder with a MinHash of their token pairs.
   Document frequencies of all tokens and the mean length cover all documents (one row per vocabulary
   entry at most, so they may be sent to all tasks).
2. Where one shard of about ``SHARD_TOKENS`` cannot hold all documents, each looks for its best neighbour
   in ``SEARCHES`` dealings: by the MinHash, which near copies share, and by terms drawn with probability in
   proportion to their BM25 weight, which documents on the same subject share.  Scores use the frequencies
   of the whole table, so the best of all dealings is taken.  Documents that these links connect get one
   label, and ranges of labels are the shards; a label that very many share is cut by the id.
3. Each shard has a BM25 inverted index of its own.  A seed document asks it, with all its terms, for
   unused neighbours, which fill the seed's window in order of their scores; the last one is cut, and its
   rest is the next seed.  Without neighbours the next unused document follows.
4. What is left at the end of a shard is cut into sequences whose lengths are powers of two, which need
   no padding, as full windows don't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bpe import codec, default_vocabulary
from corpuslens.llm.common import documents_of, written

WINDOW = 2048
END = 1  # the id after every document
SHARD_TOKENS = 6 << 20
SEARCHES = 4
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _width(size: int) -> np.dtype:
    """The narrowest type that holds every id."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _distinct(ids: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The distinct ids, without sorting; afterwards ``slots`` maps each to its place among them."""
    places = np.arange(len(ids))
    slots[ids] = places  # the last of equal ids stays
    found = ids[slots[ids] == places]
    slots[found] = np.arange(len(found))
    return found


def pair_minhash(ids: np.ndarray) -> int:
    """The least hash of pairs of neighbouring tokens, likely the same for similar texts."""
    if len(ids) < 2:
        return int(ids[0]) if len(ids) else 0
    pairs = (ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:]) * np.uint64(0x9E3779B97F4A7C15)
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((pairs ^ (pairs >> np.uint64(32))).min() >> np.uint64(1))


def _encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(summary, row, doc_id, place, ids): a row per document and, per task, one with the document frequencies."""
    schema = pa.schema([("summary", pa.bool_()), ("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        width, found, total, n = _width(len(coder.sizes)), np.zeros(len(coder.sizes), np.int64), 0, 0
        slots, task = np.zeros(len(coder.sizes), np.int64), TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple[int, bytes]] = []
                for text in batch.column(1):
                    ids = coder.encode_array(text.as_py())
                    found[_distinct(ids, slots)] += 1
                    total, n = total + len(ids) + 1, n + 1
                    rows.append((pair_minhash(ids), ids.astype(width).tobytes()))
                places, packed = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([False] * len(rows), pa.bool_()), pa.array(range(task + n - len(rows), task + n), pa.int64()), batch.column(0), pa.array(places, pa.int64()), pa.array(packed, pa.binary())], schema=schema)
        counts = np.concatenate([[n, total], found])
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.astype("<i8").tobytes()])], schema=schema)

    return written(docs.select("doc_id", "text").mapInArrow(run, "summary boolean, row long, doc_id long, place long, ids binary"), "packing-ids")


def _frequencies(encoded: DataFrame) -> dict[int, int]:
    """Sums over all tasks by place in the summary: documents, tokens, then documents of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0):
                counts = np.frombuffer(counts.as_py(), "<i8")
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["at", "n"])

    summed = encoded.where("summary").select("ids").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return {r["at"]: r["n"] for r in summed.collect()}  # the vocabulary and two, at most


def inverse_frequency(frequency: np.ndarray, n_documents: int) -> np.ndarray:
    return np.log1p((n_documents - frequency + 0.5) / (frequency + 0.5))


def term_draw(ids: np.ndarray, idf: np.ndarray, salt: int) -> int:
    """Two terms drawn with probability in proportion to their weight, the same for documents that share them."""
    term, count = np.unique(ids, return_counts=True)
    hashed = (term.astype(np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    uniform = ((hashed ^ (hashed >> np.uint64(32))) >> np.uint64(11)).astype(float) / (1 << 53)
    clock = -np.log(uniform + 1e-18) / (idf[term] * count * (K1 + 1) / (count + K1) + 1e-9)
    first = term[np.argsort(clock, kind="stable")[:2]]
    return int(first[0]) << 31 | int(first[-1])


class Index:
    """BM25 inverted index of one shard's documents."""

    def __init__(self, documents: list[np.ndarray], frequency: np.ndarray, n_documents: int, mean: float) -> None:
        terms, owners, weights = [], [], []
        idf = inverse_frequency(frequency, n_documents)
        self.queries, slots = [], np.zeros(len(frequency), np.int64)
        for d, ids in enumerate(documents):
            term = _distinct(ids, slots)
            count = np.bincount(slots[ids], minlength=len(term))
            weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * len(ids) / mean))
            terms.append(term)
            owners.append(np.full(len(term), d))
            weights.append(weight)
            self.queries.append(term)
        term, owner, weight = (np.concatenate(x) if x else np.zeros(0) for x in (terms, owners, weights))
        order = np.argsort(term, kind="stable")
        self.owners, self.weights = owner[order].astype(np.int64), weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(frequency) + 1))
        self.n = len(documents)

    def scores(self, document: int) -> np.ndarray:
        """BM25 scores of all documents for the terms of one."""
        lists = [slice(self.first[t], self.first[t + 1]) for t in self.queries[document]]
        if not lists:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.owners[x] for x in lists]), np.concatenate([self.weights[x] for x in lists]), self.n)

    def best(self, document: int) -> tuple[int, float]:
        """The best other document and its score; itself and 0 if there is none."""
        scores = self.scores(document)
        scores[document] = 0
        other = int(np.argmax(scores))
        return (other, float(scores[other])) if scores[other] > 0 else (document, 0.0)

    def every_best(self, cells: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """``best`` of every document, block by block: a matrix product over frequent terms, posting lists of the others.

        Of scores that differ by rounding alone the first counts.  ``cells`` bounds the matrix and the scores of a block.
        """
        sizes, n = np.diff(self.first), max(self.n, 1)
        frequent = np.argsort(-sizes, kind="stable")[: cells // n]
        frequent = frequent[sizes[frequent] > n // 32]
        column, weights = np.full(len(sizes), -1), np.zeros((n, len(frequent)))
        column[frequent] = np.arange(len(frequent))
        asks = np.zeros(weights.shape, bool)
        for c, t in enumerate(frequent):
            own = slice(self.first[t], self.first[t + 1])
            weights[self.owners[own], c], asks[self.owners[own], c] = self.weights[own], True
        best, score, step = np.arange(self.n), np.zeros(self.n), min(256, max(1, cells // 4 // n))
        for low in range(0, self.n, step):
            high = min(low + step, self.n)
            scores = asks[low:high].astype(float) @ weights.T
            for d in range(low, high):
                terms = self.queries[d]
                terms = terms[column[terms] < 0]
                count = sizes[terms]
                at = np.arange(count.sum()) + np.repeat(self.first[terms] - np.cumsum(count) + count, count)
                own = scores[d - low]
                own += np.bincount(self.owners[at], self.weights[at], n)
                own[d] = 0
                top = own.max()
                if top > 0:
                    best[d], score[d] = np.argmax(own >= top * (1 - 1e-12)), top
        return best, score

    def neighbours(self, document: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term, the best first."""
        scores = self.scores(document)
        scores[~unused] = 0
        size = 16
        while True:
            positive = np.flatnonzero(scores > 0)
            best = positive if len(positive) <= size else positive[np.argpartition(-scores[positive], size)[:size]]
            yield from (int(d) for d in best[np.lexsort([best, -scores[best]])])
            if len(positive) <= size:
                return
            scores[best] = 0  # the next round is about the others, whichever of equal scores came first
            size *= 4


def order_by_retrieval(documents: list[np.ndarray], index: Index, window: int = WINDOW) -> list[int]:
    """The order in which the documents of a shard follow each other."""
    unused, order, position, first = np.ones(len(documents), bool), [], 0, 0
    while len(order) < len(documents):
        if not order or position % window == 0:
            while not unused[first]:
                first += 1
            order.append(first)
            unused[first] = False
            position += len(documents[first])
            continue
        filled = position // window  # windows that are full by now
        for d in index.neighbours(order[-1], unused):
            order.append(d)
            unused[d] = False
            position += len(documents[d])
            if position // window > filled:
                break
        else:
            if len(order) < len(documents):
                while not unused[first]:
                    first += 1
                order.append(first)
                unused[first] = False
                position += len(documents[first])
    return order


def sequence_lengths(total: int, window: int = WINDOW) -> list[int]:
    """Full windows, then powers of two, the largest first."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(lengths: list[int], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(place in order, start, length, sequence, offset) of documents laid end to end."""
    sequences = sequence_lengths(sum(lengths), window)
    sequence, offset = 0, 0
    for place, length in enumerate(lengths):
        start = 0
        while start < length:
            size = min(length - start, sequences[sequence] - offset)
            yield place, start, size, sequence, offset
            start, offset = start + size, offset + size
            if offset == sequences[sequence]:
                sequence, offset = sequence + 1, 0


def _best_links(rows: DataFrame, shards: int, size: int, frequency: np.ndarray, n_documents: int, mean: float, searches: int) -> DataFrame:
    """(row, place, best): the best neighbour of each document over all dealings, itself without any."""

    def keyed(salt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf = inverse_frequency(frequency, n_documents)
            for batch in batches:
                ids = [np.append(np.frombuffer(x.as_py(), _width(size)), END) for x in batch.column(2)]
                key = pa.array([term_draw(x, idf, salt) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, key], names=["row", "place", "ids", "key"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, place, tokens = [], [], []
        for batch in batches:
            row += batch.column(0).to_pylist()
            place += batch.column(1).to_pylist()
            tokens += [np.append(np.frombuffer(x.as_py(), _width(size)), END).astype(np.uint32) for x in batch.column(2)]
        if not row:
            return
        index = Index(tokens, frequency, n_documents, mean)
        best, score = index.every_best()
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(place, pa.int64()), pa.array([row[b] for b in best], pa.int64()), pa.array(score, pa.float64())],
            names=["row", "place", "best", "score"])

    found = []
    for salt in range(searches):
        one = rows.select("row", "place", "ids")
        one = one.mapInArrow(keyed(salt), "row long, place long, ids binary, key long") if salt else one.withColumn("key", F.col("place"))
        one = one.repartitionByRange(shards, "key", "row").sortWithinPartitions("key", "row").select("row", "place", "ids")
        found.append(written(one.mapInArrow(search, "row long, place long, best long, score double"), "packing-links"))
    links = found[0]
    for other in found[1:]:
        links = links.union(other)
    return links.groupBy("row").agg(F.first("place").alias("place"), F.max_by("best", F.struct("score", -F.col("best"))).alias("best"))


def _labels(links: DataFrame) -> DataFrame:
    """(row, label): the least (place, row) of the circle that following the best neighbours ends in, by doubling."""
    own = F.struct("place", "row")
    state = written(links.select("row", F.col("best").alias("to"), own.alias("low"), F.lit(None).cast("struct<place:long,row:long>").alias("label")), "packing-labels")
    while True:
        after = state.select(F.col("row").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        step = state.join(after, "to").select(
            "row", F.col("next").alias("to"), F.least("low", "next_low").alias("low"), F.col("next_low").alias("label"),
            (~F.col("label").eqNullSafe(F.col("next_low"))).alias("moved"))
        step = written(step, "packing-labels")
        if step.where("moved").isEmpty():
            return step.select("row", "label")
        state = step.drop("moved")


def pack(
    docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, searches: int = SEARCHES,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    A null or empty text is its end mark alone; repeated rows are documents of their own.  Sequence ids are
    unique and grow within a shard.
    """
    vocabulary = vocabulary or default_vocabulary()
    encoded = _encoded(documents_of(docs), vocabulary)
    found = _frequencies(encoded)
    n_documents, n_tokens = found.pop(0, 0), found.pop(1, 0)
    shards = max(1, -(-n_tokens // shard_tokens))
    rows = encoded.where("not summary").select("row", "doc_id", "ids", "place").withColumn("draw", F.xxhash64("ids"))
    vocabulary_size = len(codec(vocabulary).sizes)
    frequency = np.zeros(vocabulary_size)
    frequency[[at - 2 for at in found]] = list(found.values())
    frequency[END] = n_documents  # every document ends with it, so it says nothing
    order = ["place", "doc_id", "draw"]
    if shards > 1:
        links = _best_links(rows, shards, vocabulary_size, frequency, n_documents, n_tokens / n_documents, searches)
        rows = rows.join(_labels(links), "row")
        order = ["label", *order]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    sent = dealt.select("doc_id", "ids", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(codec(vocabulary).sizes)
        ids, tokens, shard = [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            shard = batch.column(2)[0].as_py() if batch.num_rows else shard
            tokens += [np.append(np.frombuffer(x.as_py(), _width(size)), END).astype(np.uint32) for x in batch.column(1)]
        if not tokens:
            return
        order = order_by_retrieval(tokens, Index(tokens, frequency, n_documents, n_tokens / n_documents), window)
        out: list[tuple] = []
        for place, start, length, sequence, offset in pieces([len(tokens[d]) for d in order], window):
            d = order[place]
            crc = zlib.crc32(tokens[d][start : start + length].astype("<u4").tobytes())
            out.append((ids[d], start, length, crc, len(tokens[d]), (shard << 40) + sequence, offset))
        schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return sent.mapInArrow(run, SCHEMA)
