"""Token-ID files of patched frame-of-reference blocks.

A folder of files holds all token ids of a corpus in ascending order of doc_id (null ids first, then by text),
an end id after each document.  A *segment* is a run of whole documents with about ``SEGMENT_IDS`` ids.  It
consists of a header and three *streams*: doc ids, lengths, token ids.  A stream is cut into blocks of
``BLOCK`` values; of a block, the minimum is subtracted, the differences are packed at the bit width of
their ``PERCENTILE``, and what is wider is patched: its low bits are packed like the others, the rest
stands in the block's exception list with its place.  The byte starts of a stream's blocks precede them, so
that a range of ids is read from the blocks that hold it.

::

    file     segment "\\n" segment "\\n" ...
    segment  magic 4s, shard u32, number u32, start u64, n_docs u32, n_null u32, three stream sizes u64, streams
    stream   n u64, n_blocks u32, block starts u32 ..., blocks (the last filled up with its minimum)
    block    minimum i64, width u8, bytes of an exception u8, n_exceptions u16, packed bits, places u16 ..., rests

The files are written by Spark's own text writer, a segment per row, which gives its commit protocol, any
file system, and the line ends; ``binaryFile`` reads them.  ``shard`` numbers the writing tasks in order,
``start`` counts the ids before a segment in its shard.  A text never leaves its row, so that a segment is as
long as the longest text at most beyond ``SEGMENT_IDS``.

Null texts are empty: they are encoded as the end id alone, as are texts of white space.  Repeated rows are
documents of their own.  An empty table gives no documents.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.bpe import _byte_letters
from corpuslens.llm.common import documents_of, once_per_process
from corpuslens.session import shared_directory

BLOCK = 512
PERCENTILE = 90
SEGMENT_IDS = 1 << 20
SEGMENTS_PER_FILE = 32
END_ID = 1
CACHED_WORDS = 500_000
MAGIC = b"PFR1"
HEADER, STREAM, BLOCK_HEAD = "<4sIIQIIQQQ", "<QI", "<qBBH"  # little-endian, without padding
POWERS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts from a ``tokenizers`` file whose pattern never matches across white space.

    The library encodes every different word once (all new words of some texts in one call) and the words'
    ids are put together.  This holds where a word is simple to find: characters of ASCII and the letters
    of Latin-1, which no normal form changes and which have one lower case.  Whatever else stands between
    white space is given to the library as it is.  A file of another kind is used through the library alone.
    """

    LETTERS = "ß-öø-ÿ"
    PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\\sa-z0-9{LETTERS}]+")
    SPACE = re.compile("[ \t\n\r]+")

    def __init__(self, path: str, verified: bool = False) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        pattern = next(iter((described.get("pre_tokenizer") or {}).get("pretokenizers", [])), {}).get("pattern", {}).get("Regex")
        kinds = [n.get("type") for n in (described.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and kinds == ["NFC", "Replace", "Lowercase"]
            and described["model"].get("end_of_word_suffix") == "</w>"
        )
        self.marks = [t["content"] for t in described.get("added_tokens", [])]
        self.of_words = self._word_codec(described["model"], verified) if self.by_word else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def _word_codec(self, model: dict, verified: bool):
        """A ``tiktoken`` codec for simple words that each end in a space, which stands for the mark of a word's end.

        It merges neighbours whose concatenation is the lowest token, the library those that are the lowest
        merge.  Both do the same if merging each token's own string gives that token: within the letters of
        a token, merges run as they do in the token alone, so that the last two parts are those of its merge.
        This and the order of the ids are checked here, unless the file is ``verified`` already; where they do
        not hold, the library encodes all words.
        """
        import tiktoken

        letters, end = _byte_letters(), "</w>"
        marks = set(self.marks)
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token not in marks:
                ranks[bytes(letters[c] for c in token.removesuffix(end)) + b" " * token.endswith(end)] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        ordered = all(a < b for a, b in zip([511, *made], made, strict=False)) and sorted(ranks.values()) == list(range(len(ranks))) and len(ranks) == 512 + len(made)
        if not ordered or any(model["vocab"].get(c + end, 512) > 511 or model["vocab"].get(c, 512) > 511 for c in letters):
            return None
        rank = {(a, b): n for n, (a, b) in enumerate(merges)}
        for a, b in [] if verified else merges:
            whole = a + b
            parts = [*whole.removesuffix(end)]
            parts[-1] += end * whole.endswith(end)
            while len(parts) > 1:  # the lowest merge, the first of equal ones
                at = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
                if (parts[at], parts[at + 1]) not in rank:
                    return None
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words in one call; a word ends where a token does that ends words."""
        if self.of_words is None:
            self.known.update((w, self._by_library(w)) for w in words)
            return
        ids = self.of_words.encode_to_numpy(" ".join(words) + " ", disallowed_special=()).astype("<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):
            self.known.update((w, self._by_library(w)) for w in words)
            return
        parts, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * last).tolist(), strict=True):
            self.known[word] = parts[at:end]
            at = end

    def _parts(self, text: str) -> Iterator[list[str] | str]:
        """Lists of simple words, and what else stands between white space."""
        marked = any(m in text for m in self.marks)
        if not marked and self.PLAIN.fullmatch(text):
            yield self.WORDS.findall(text.lower())
            return
        plain: list[str] = []
        for chunk in self.SPACE.split(text):
            if self.PLAIN.fullmatch(chunk) and not (marked and any(m in chunk for m in self.marks)):
                plain.append(chunk)
                continue
            if plain:
                yield self.WORDS.findall(" ".join(plain).lower())
                plain = []
            yield chunk
        yield self.WORDS.findall(" ".join(plain).lower())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [self._by_library(t) for t in texts]
        split = [list(self._parts(t)) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = set().union(*(p for parts in split for p in parts if isinstance(p, list))).difference(self.known)
        if new:
            self._learn(sorted(new))
        ids = self.known.__getitem__
        return [b"".join([b"".join(map(ids, p)) if isinstance(p, list) else self._by_library(p) for p in parts]) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def pack(values: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """A stream of signed 64-bit integers."""
    values = np.asarray(values, np.int64)
    n, n_blocks = len(values), -(-len(values) // block)
    if not n:
        return struct.pack(STREAM, 0, 0)
    table = np.concatenate([values, np.full(n_blocks * block - n, values[(n_blocks - 1) * block :].min(), np.int64)]).reshape(n_blocks, block)
    least = table.min(axis=1)
    above = (table.astype(np.uint64) - least.astype(np.uint64)[:, None])
    place = min(block - 1, block * percentile // 100)
    widths = np.searchsorted(POWERS, np.partition(above, place, axis=1)[:, place], side="right")
    rest = np.where((widths < 64)[:, None], above >> np.minimum(widths, 63).astype(np.uint64)[:, None], np.uint64(0))
    packed: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows) if width else 0, 64):
            part = rows[at : at + 64]
            bits = np.unpackbits(np.ascontiguousarray(above[part]).view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little")
            for row, data in zip(part.tolist(), np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little"), strict=True):
                packed[row] = data.tobytes()
    over = rest.max(axis=1)
    sizes = np.where(over < 1 << 8, 1, np.where(over < 1 << 16, 2, np.where(over < 1 << 32, 4, 8)))
    places_of, starts, out, at = np.nonzero(rest), np.zeros(n_blocks, "<u4"), [], 0
    borders = np.searchsorted(places_of[0], np.arange(n_blocks + 1))
    for i in range(n_blocks):
        places = places_of[1][borders[i] : borders[i + 1]]
        patches = places.astype("<u2").tobytes() + rest[i, places].astype(f"<u{sizes[i]}").tobytes()
        data = struct.pack(BLOCK_HEAD, int(least[i]), int(widths[i]), int(sizes[i]), len(places)) + packed[i] + patches
        starts[i] = at
        at += len(data)
        out.append(data)
    return struct.pack(STREAM, n, n_blocks) + starts.tobytes() + b"".join(out)


def unpack(stream: bytes | memoryview, first: int = 0, last: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Values ``first`` to ``last`` (exclusive) of a stream, from the blocks that hold them."""
    stream = memoryview(stream)
    n, n_blocks = struct.unpack_from(STREAM, stream)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.int64)
    low, high = first // block, -(-last // block)
    starts = np.frombuffer(stream, "<u4", n_blocks, struct.calcsize(STREAM))
    body = struct.calcsize(STREAM) + 4 * n_blocks
    heads = [(body + int(s), *struct.unpack_from(BLOCK_HEAD, stream, body + int(s))) for s in starts[low:high]]
    widths = np.array([h[2] for h in heads])
    out = np.zeros((high - low, block), np.uint64)
    for width in np.unique(widths).tolist():
        rows, size = np.flatnonzero(widths == width), block * width // 8 + bool(block * width % 8)
        for at in range(0, len(rows) if width else 0, 64):
            part = rows[at : at + 64]
            data = np.stack([np.frombuffer(stream, np.uint8, size, heads[r][0] + struct.calcsize(BLOCK_HEAD)) for r in part.tolist()])
            bits = np.unpackbits(data, axis=1, count=block * width, bitorder="little").reshape(-1, width)
            bytes_of = np.zeros((len(bits), 8), np.uint8)
            bytes_of[:, : -(-width // 8)] = np.packbits(bits, axis=1, bitorder="little")
            out[part] = bytes_of.view("<u8").reshape(len(part), block)
    for i, (at, _, width, size, count) in enumerate(heads):
        if count:
            at += struct.calcsize(BLOCK_HEAD) + block * width // 8 + bool(block * width % 8)
            places = np.frombuffer(stream, "<u2", count, at)
            out[i, places] |= np.frombuffer(stream, f"<u{size}", count, at + 2 * count).astype(np.uint64) << np.uint64(width)
    out += np.array([h[1] for h in heads], np.int64).astype(np.uint64)[:, None]
    return out.reshape(-1).view(np.int64)[first - low * block : last - low * block]


def segment(shard: int, number: int, start: int, doc_ids: list[int | None], lengths: list[int], ids: bytes) -> bytes:
    """The bytes of a segment; documents without an id come first."""
    n_null = sum(d is None for d in doc_ids)
    streams = [pack(np.array(doc_ids[n_null:], np.int64)), pack(np.array(lengths, np.int64)), pack(np.frombuffer(ids, "<u4"))]
    return struct.pack(HEADER, MAGIC, shard, number, start, len(doc_ids), n_null, *map(len, streams)) + b"".join(streams)


def segments_of(content: bytes | memoryview) -> Iterator[tuple[int, tuple, memoryview]]:
    """(byte offset, header, streams) of the segments of a file."""
    content, at = memoryview(content), 0
    while at < len(content):
        header = struct.unpack_from(HEADER, content, at)
        if header[0] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        size = sum(header[6:9])
        yield at, header, content[at + struct.calcsize(HEADER) : at + struct.calcsize(HEADER) + size]
        at += struct.calcsize(HEADER) + size + 1


def write_tokens(docs: DataFrame, target: str, vocabulary: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the files to ``target``/ids.

    Rows are dealt by ranges of (doc_id, text hash, row), so that an id that very many rows share is
    written by many tasks; each task encodes, packs and writes one segment at a time.
    """
    vocabulary = vocabulary or default_vocabulary()
    verified = WordEncoder(vocabulary).of_words is not None  # once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once_per_process(("word-encoder", vocabulary), lambda: WordEncoder(vocabulary, verified))
        end, shard = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        number = start = held = 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(shard, number, start, doc_ids, lengths, b"".join(parts))], pa.binary())], names=["value"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few texts as Python strings
                rows = batch.slice(at, 64)
                for doc_id, own in zip(rows.column(0).to_pylist(), coder.encode_all(rows.column(1).to_pylist()), strict=True):
                    ids = own + end
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) // 4)
                    parts.append(ids)
                    held += lengths[-1]
                    if held >= segment_ids:
                        yield closed()
                        number, start, held, doc_ids, lengths, parts = number + 1, start + held, 0, [], [], []
        if doc_ids:
            yield closed()

    rows = documents_of(docs).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    # Spark's text writer copies bytes as they are and ends every row with a line end.
    out = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).option("compression", "none").text(f"{target}/ids")


def _files(spark: SparkSession, target: str, paths: list[str] | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
    return reader.load(paths if paths is not None else f"{target}/ids").select("path", "content")


def write_index(spark: SparkSession, target: str) -> DataFrame:
    """(path, offset, shard, number, start, n_ids, n_docs) of every segment, from the headers; written to ``target``/index."""
    schema = "path string, offset long, shard int, number int, start long, n_ids long, n_docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for at, head, streams in segments_of(content.as_buffer()):
                    n_ids = struct.unpack_from(STREAM, streams, head[6] + head[7])[0]
                    rows.append({"path": path.as_py(), "offset": at, "shard": head[1], "number": head[2], "start": head[3], "n_ids": n_ids, "n_docs": head[4]})
                if rows:
                    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(rows[0], types, strict=True)], names=list(rows[0]))

    index = _files(spark, target).mapInArrow(run, schema)
    index.write.parquet(f"{target}/index")
    return spark.read.schema(index.schema).parquet(f"{target}/index")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The segments with ``first``, the ids of the whole corpus before each.

    Totals of the shards, a row for each task that wrote, are summed up in order and broadcast.
    """
    index = spark.read.parquet(f"{target}/index")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.cast("long").alias("shard_first"))
    return index.join(F.broadcast(shards), "shard").withColumn("first", F.col("shard_first") + F.col("start"))


def read_documents(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ``start`` counts all ids before it, ``ids`` are little-endian unsigned 32-bit integers."""
    schema = "shard int, doc_id long, place long, n_tokens long, ids binary"
    arrow = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                for _, head, streams in segments_of(content.as_buffer()):
                    own, lengths = unpack(streams[: head[6]]), unpack(streams[head[6] : head[6] + head[7]])
                    ids = unpack(streams[head[6] + head[7] :]).astype("<u4").tobytes()
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    cut = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = [[head[1]] * head[4], [None] * head[5] + own.tolist(), starts + head[3], lengths, cut]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    shards = read_index(spark, target).groupBy("shard").agg(F.first("shard_first").alias("shard_first"))
    rows = _files(spark, target).mapInArrow(run, schema).join(F.broadcast(shards), "shard")
    return rows.select("doc_id", (F.col("shard_first") + F.col("place")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, target: str, first: int, length: int) -> DataFrame:
    """(position, id) of ``length`` ids from ``first`` on, from the blocks that hold them.

    Only files with a segment in the range are opened; their number grows with ``length``, not with the corpus.
    """
    held = read_index(spark, target).where((F.col("first") < first + length) & (F.col("first") + F.col("n_ids") > first)).select("path", "offset", "first").collect()
    wanted: dict[str, dict[int, int]] = {}
    for row in held:
        wanted.setdefault(row["path"], {})[row["offset"]] = row["first"]
    schema = "position long, id long"
    if not wanted:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, head, streams in segments_of(content.as_buffer()):
                    start = wanted[path].get(at)
                    if start is not None:
                        low = max(0, first - start)
                        ids = unpack(streams[head[6] + head[7] :], low, first + length - start)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(start + low, start + low + len(ids))), pa.array(ids)], names=["position", "id"])

    return _files(spark, target, sorted(wanted)).mapInArrow(run, schema)


def ids_crc32(ids: Column) -> Column:
    return F.crc32(ids).cast("long")


def token_file_digests(docs: DataFrame, target: str | None = None, **settings) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``docs`` are written to."""
    spark = docs.sparkSession
    target = target or f"{shared_directory(spark)}/corpuslens/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, target, **settings)
    write_index(spark, target)
    return read_documents(spark, target).select("doc_id", "start", "n_tokens", ids_crc32(F.col("ids")).alias("ids_crc32"))
