"""Suffix-array dedup: bytes covered by a 400-byte string that starts more than once in the corpus.

Suffixes of a whole corpus need not be sorted in one place: two equal 400-byte windows are equal in
whatever is computed from their bytes.  So every window is filed under its *anchor*, the 128-byte string
with the smallest hash among those it contains (the leftmost of ties), and only anchors that occur at
least twice are looked into.  Consecutive windows with one anchor form a *context*: the bytes from the
first window's start to the last one's end.

1. Anchors of every text; the repeated ones, by a sum that combines before the shuffle.
2. Contexts of repeated anchors, as 128-bit digests first: contexts that recur whole are counted there,
   and the text of only one copy travels on, only where an anchor has several different contexts.
3. Contexts of an anchor meet in a block, whose suffix array is built by two-stage sorting
   (``equal_windows``): suffixes smaller than their successor are sorted directly, all others are induced
   from their successors by a scan over the buckets of first symbols; neighbours in the array with a
   common prefix of 400 bytes or more are repeated windows.
4. The windows found return to their texts, and the bytes that they cover are removed.

An anchor with more than ``GROUP_LIMIT`` different contexts (a passage in very many documents) is too
large for one block; its windows are counted by digest, which combines before the shuffle, instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import add_columns, once_per_process, written

SIZE = 400
ANCHOR = 128
BLOCK_BYTES = 1 << 20
GROUP_LIMIT = 2000  # contexts that a block holds at most
SEGMENT = 1 << 20
_POSITION_BITS = 21
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 to the 64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    rows = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: bytes, size: int = SIZE, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, end of window starts) of every context of a text."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    powers, inverse = once_per_process(("powers", SEGMENT + size), lambda: _powers(SEGMENT + size))
    for at in range(0, len(data) - size + 1, SEGMENT):
        part = np.frombuffer(data, np.uint8, min(SEGMENT + size - 1, len(data) - at), at).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers[: len(part)], out=sums[1:])
        mixed = (sums[anchor:] - sums[:-anchor]) * inverse[: len(part) - anchor + 1]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        least = (_sliding_minimum((mixed & ~low) | np.arange(len(mixed), dtype=np.uint64), size - anchor + 1) & low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(least)) + 1
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(least)]])
        for column, values in zip(found, (mixed[least[first]], first + at, last + at), strict=True):
            column.append(values)
    hashes, first, last = (np.concatenate(column) for column in found)
    return hashes.astype(np.int64), first, last


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def equal_windows(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For every window start of every text, whether the window starts elsewhere in these texts too."""
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts])
    symbols = np.zeros(int(lengths.sum()) + len(texts) + size + 128, np.int64)  # 0 ends a text, bytes are one more
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    for at, text in zip(starts, texts, strict=True):
        symbols[at : at + len(text)] = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    n = len(symbols)
    counts = np.maximum(lengths - size + 1, 0)
    wanted = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts, strict=True)])

    # Names in the order of the substrings of 7, 14, 28 and 56 symbols.
    names = np.zeros(n, np.int64)
    for i in range(7):
        names = (names << 9) | np.concatenate([symbols[i:], np.zeros(i, np.int64)])
    names, width = np.unique(names, return_inverse=True)[1], 7
    while width < 56:
        names = np.unique(names * n + np.concatenate([names[width:], np.zeros(width, np.int64)]), return_inverse=True)[1]
        width *= 2

    # Types: a suffix is small if it is smaller than its successor; equal symbols take the next type.
    # End marks count as small, so that every chain of induced suffixes ends within its text.
    step = np.sign(np.diff(symbols, append=0))
    differs = np.minimum.accumulate(np.where(step != 0, np.arange(n), n - 1)[::-1])[::-1]
    small = (step[differs] > 0) | (symbols == 0)

    # The suffixes needed: the windows' own and, for those to be induced, their successors.
    needed = np.zeros(n, bool)
    needed[wanted] = True
    front = wanted[~small[wanted]]
    while len(front):
        front = front[~needed[front + 1]] + 1
        needed[front] = True
        front = front[~small[front]]

    # Stage one: sort the small suffixes directly, on names that reach beyond the window.
    direct = np.flatnonzero(needed & small)
    reach = range(-(-size // 56) * 56 - 56, -1, -56)
    padded = np.concatenate([names, np.zeros(size + 112, np.int64)])
    direct = direct[np.lexsort([padded[direct + r] for r in reach])] if len(direct) else direct

    # Stage two: bucket by bucket of the first symbol, induced suffixes come before the small ones.
    rank, given = np.full(n, -1, np.int64), 0
    induced = np.flatnonzero(needed & ~small)
    induced = induced[np.argsort(symbols[induced], kind="stable")]
    by_symbol = lambda p: np.searchsorted(symbols[p], np.arange(258))
    large_at, small_at = by_symbol(induced), by_symbol(direct)
    for symbol in range(257):
        waiting = induced[large_at[symbol] : large_at[symbol + 1]]
        while len(waiting):
            ready = rank[waiting + 1] >= 0
            now = waiting[ready]
            now = now[np.argsort(rank[now + 1], kind="stable")]
            rank[now] = np.arange(given, given + len(now))
            given, waiting = given + len(now), waiting[~ready]
        here = direct[small_at[symbol] : small_at[symbol + 1]]
        rank[here] = np.arange(given, given + len(here))
        given += len(here)

    # Adjacent common prefixes, among the windows.
    array = wanted[np.argsort(rank[wanted], kind="stable")]
    same = np.ones(max(len(array) - 1, 0), bool)
    for r in [*range(0, size - 56, 56), size - 56] if size >= 56 else []:
        same &= names[array[:-1] + r] == names[array[1:] + r]
    if size < 56:  # short windows, in tests: symbol by symbol
        for r in range(size):
            same &= symbols[array[:-1] + r] == symbols[array[1:] + r]
    repeated = np.zeros(n, bool)
    repeated[array[:-1][same]] = True
    repeated[array[1:][same]] = True
    return [repeated[s : s + c] for s, c in zip(starts, counts, strict=True)]


def runs(flags: np.ndarray) -> list[int]:
    """start, end, start, end, ... of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


def _blocks(size: int, block_bytes: int) -> Callable:
    """Suffix arrays over rows that are sorted by anchor, a block of whole anchor groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        held_bytes, last = 0, None

        def flush() -> pa.RecordBatch:
            found = [runs(flags) for flags in equal_windows([text for _, text in held], size)]
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.binary()), pa.array(found, pa.list_(pa.int32()))], names=["digest", "runs"])

        for batch in batches:
            for anchor, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held_bytes >= block_bytes and anchor != last:
                    yield flush()
                    held, held_bytes = [], 0
                held.append((digest, text))
                held_bytes, last = held_bytes + len(text), anchor
        if held:
            yield flush()

    return run


def _with_wanted(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """The documents with ``text_key`` and ``anchors``, those of their anchors that occur at least twice."""
    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))

    def start():
        def each(texts: list[str]) -> list[list]:
            rows = [np.unique(contexts(t.encode(), size, anchor)[0], return_counts=True) for t in texts]
            return [[[{"anchor": a, "n": n} for a, n in zip(h.tolist(), c.tolist(), strict=True)] for h, c in rows]]

        return each

    texts = keyed.select("text_key", "text").where(F.octet_length("text") >= size)
    found = written(add_columns(texts, "found array<struct<anchor:bigint,n:bigint>>", start, ["text_key"]).select("text_key", F.inline("found")), "anchors")
    repeated = found.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    wanted = written(found.join(repeated, "anchor").groupBy("text_key").agg(F.collect_set("anchor").alias("anchors")), "wanted")
    return keyed.join(wanted, "text_key", "left")


def _contexts_of(data: bytes, anchors: list[int] | None, size: int, anchor: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(anchor, first window start, end of starts, digest, bytes) of the contexts of some anchors."""
    if not anchors:
        return
    hashes, first, last = contexts(data, size, anchor)
    for i in np.flatnonzero(np.isin(hashes, np.array(anchors, np.int64))).tolist():
        part = data[first[i] : last[i] + size - 1]
        yield int(hashes[i]), int(first[i]), int(last[i]), _digest(part), part


def _arrow_map(rows: DataFrame, schema: str, function: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Rows made from each row, 64 at a time."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    target = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                made = [r for row in whole.slice(at, 64).to_pylist() for r in function(row)]
                columns = list(zip(*made, strict=True)) if made else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, target)


def _marked(docs: DataFrame, size: int, anchor: int, block_bytes: int, group_limit: int, keep_texts: bool) -> tuple[DataFrame, DataFrame]:
    """(state, coverage): the documents with text_key, and by text_key the repeated windows of its contexts."""
    joined = _with_wanted(docs, size, anchor)
    kept = F.col("text") if keep_texts else F.when(F.col("anchors").isNotNull(), F.col("text"))
    text = F.coalesce("text", F.lit(""))
    state = joined.withColumns({"n_bytes": F.octet_length(text).cast("long"), "whole_sha256": F.sha2(text, 256), "text": kept})
    state = written(state, "dedup-state")
    candidates = state.where("anchors is not null")

    def digests(row: dict) -> Iterator[tuple]:
        for hashed, _, _, digest, _ in _contexts_of(row["text"].encode(), row["anchors"], size, anchor):
            yield row["text_key"], hashed, digest

    seen = written(_arrow_map(candidates.select("text_key", "text", "anchors"), "text_key long, anchor long, digest binary", digests), "contexts")
    different = written(seen.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min("text_key").alias("owner")), "different")
    groups = different.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
    several = different.join(groups, "anchor")

    # One copy of each context's text, from the text that owns it.
    owners = several.groupBy("owner").agg(F.collect_set("digest").alias("digests"))
    owned = candidates.select("text_key", "text", "anchors").dropDuplicates(["text_key"])
    owned = owned.join(owners, owned["text_key"] == owners["owner"]).select("text", "anchors", "digests")

    def copies(row: dict) -> Iterator[tuple]:
        left = set(row["digests"])
        for hashed, _, _, digest, part in _contexts_of(row["text"].encode(), row["anchors"], size, anchor):
            if digest in left:
                left.discard(digest)
                yield hashed, digest, part

    parts = _arrow_map(owned, "anchor long, digest binary, part binary", copies)
    large = groups.where(F.col("contexts") > group_limit).select("anchor")
    parts = written(parts.join(large.withColumn("large", F.lit(True)), "anchor", "left"), "parts")
    blocks = parts.where("large is null").select("anchor", "digest", "part").repartition("anchor").sortWithinPartitions("anchor", "digest")
    found = blocks.mapInArrow(_blocks(size, block_bytes), "digest binary, runs array<int>")

    def windows(row: dict) -> Iterator[tuple]:
        for at in range(len(row["part"]) - size + 1):
            yield row["digest"], at, _digest(row["part"][at : at + size])

    single = _arrow_map(parts.where("large").select("digest", "part"), "digest binary, start int, window binary", windows)
    again = single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    starts = single.join(again, "window").groupBy("digest").agg(F.collect_set("start").alias("starts"))
    found = found.unionByName(starts.select("digest", F.flatten(F.transform("starts", lambda s: F.array(s, s + 1))).alias("runs")))

    # A context that recurs whole is repeated in all its windows (null runs: all of them).
    whole = different.where("n > 1").select("digest", F.lit(None).cast("array<int>").alias("runs"))
    partly = found.join(different.where("n > 1").select("digest"), "digest", "left_anti").where(F.size("runs") > 0)
    marks = written(whole.unionByName(partly), "marks")
    coverage = seen.select("text_key", "digest").distinct().join(marks, "digest")
    coverage = coverage.groupBy("text_key").agg(F.collect_list(F.struct("digest", "runs")).alias("marks"))
    return state, written(coverage, "coverage")


def removed_spans(data: bytes, anchors: list[int], marks: list[dict], size: int = SIZE, anchor: int = ANCHOR) -> list[tuple[int, int]]:
    """Maximal runs of bytes under repeated windows."""
    by_digest = {bytes(m["digest"]): m["runs"] for m in marks}
    flags = np.zeros(len(data) + 1, np.int32)
    for _, first, last, digest, _ in _contexts_of(data, anchors, size, anchor):
        if digest in by_digest:
            edges = by_digest[digest]
            edges = [0, last - first] if edges is None else edges
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                flags[first + lo] += 1
                flags[first + hi - 1 + size] -= 1
    edges = runs(np.cumsum(flags[:-1]) > 0)
    return list(zip(edges[::2], edges[1::2], strict=True))


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_spans(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, spans, n_removed, n_spans, kept_sha256) of every document.

    Texts are judged as UTF-8 bytes, null texts as empty; repeated rows repeat each other.  Spans are
    maximal removed runs of bytes, ends exclusive.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    state, coverage = _marked(docs, size, anchor, block_bytes, group_limit, False)
    touched = state.where("anchors is not null").join(coverage, "text_key", "left")

    def cut(row: dict) -> Iterator[tuple]:
        data = row["text"].encode()
        spans = removed_spans(data, row["anchors"], row["marks"] or [], size, anchor)
        yield row["doc_id"], len(data), [list(s) for s in spans], sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()

    schema = "doc_id long, n_bytes long, spans array<array<int>>, n_removed long, n_spans long, kept_sha256 string"
    changed = _arrow_map(touched.select("doc_id", "text", "anchors", "marks"), schema, cut)
    none = F.lit(0).cast("long")
    same = state.where("anchors is null").select("doc_id", "n_bytes", F.array().cast("array<array<int>>").alias("spans"), none.alias("n_removed"), none.alias("n_spans"), F.col("whole_sha256").alias("kept_sha256"))
    return same.unionByName(changed)


def remove_repeats(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The documents, all columns kept, without the repeated bytes of ``text``.

    A character of which only some bytes are removed goes whole; a null text stays null.
    """
    # Names that no column of the input can clash with, and back.
    names = docs.columns
    inner = docs.select(*[docs[c].alias("text" if c == "text" else f"own_{i}") for i, c in enumerate(names)])
    state, coverage = _marked(inner, size, anchor, block_bytes, group_limit, True)
    touched = state.join(coverage, "text_key", "left")

    def start_rows(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                place = {n: batch.schema.get_field_index(n) for n in ("text", "anchors", "marks")}
                texts = batch.column(place["text"]).to_pylist()
                for i, (anchors, marks) in enumerate(zip(batch.column(place["anchors"]).to_pylist(), batch.column(place["marks"]).to_pylist(), strict=True)):
                    if marks:
                        data = texts[i].encode()
                        texts[i] = kept_bytes(data, removed_spans(data, anchors, marks, size, anchor)).decode("utf-8", errors="ignore")
                columns = [pa.array(texts, batch.schema.field(place["text"]).type) if n == place["text"] else c for n, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns[: len(inner_names)], names=inner_names)

    inner_names = inner.columns
    marked = touched.where("marks is not null").select(*inner_names, "anchors", "marks")
    clean = marked.mapInArrow(start_rows, inner.schema)
    rest = touched.where("marks is null").select(*inner_names)
    return rest.unionByName(clean).select(*[F.col(n).alias(c) for n, c in zip(inner_names, names, strict=True)])
