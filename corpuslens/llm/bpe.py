"""BPE encoding and decoding, with tree concatenation of long texts.

A text above ``LEAF_CHARS`` code points is halved until no part is longer, the parts are encoded as rows
of their own, by any tasks, and joined two by two.  At a join, a window of the last tokens on the left and
the first on the right is re-encoded.  If its first token is again the left side's at that place and its
last token the right side's, every pair of neighbouring tokens is one that BPE itself puts side by side,
which makes the whole sequence the encoding of the whole text; otherwise the window doubles, up to both
whole sides.  Windows start wider than any special token, so that one cut in two is found, and never end
within or after white space, which the pattern splits by what follows it.

The vocabulary is read from a ``tokenizers`` file (byte-level BPE, ids in merge order) whose path is a
parameter and must exist on every executor.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import add_columns, documents_of, once_per_process

LEAF_CHARS = 1 << 16
FIRST_WINDOW = 64
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, letters = described["model"], _byte_letters()
        before = described.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or described.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        numbers = [model["vocab"][a + b] for a, b in merges]
        if any(a >= b for a, b in zip(numbers, numbers[1:], strict=False)):
            raise ValueError("ids must be in the order of the merges")
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)
        size = max([*ranks.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes_of[i] = token
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.numerals = [str(i) for i in range(size)]
        self.first_window = max([FIRST_WINDOW, *(2 * len(t.encode()) for t in special)])

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode(text, allowed_special=self._special, disallowed_special=())

    def encode_array(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special=self._special, disallowed_special=())

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")

    def decimal(self, ids) -> str:
        return ",".join(map(self.numerals.__getitem__, ids))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two texts' concatenation from their encodings."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        left_at, right_at = np.cumsum(self.sizes[left][::-1]), np.cumsum(self.sizes[right])  # bytes from the join to each token's far end
        window = self.first_window
        while True:
            i, j = int(np.searchsorted(left_at, window)) + 1, int(np.searchsorted(right_at, window)) + 1
            i, j = min(i, len(left)), min(j, len(right))
            while i < len(left) and self._continues(left[len(left) - i]):
                i += 1
            while j < len(right) and (self._continues(right[j]) or self._ends_in_space(right[max(0, j - 4) : j])):
                j += 1
            inside = b"".join(map(self.bytes_of.__getitem__, [*left[len(left) - i :], *right[:j]]))
            again = self.encode(inside.decode("utf-8"))
            if (i == len(left) or again[0] == left[len(left) - i]) and (j == len(right) or again[-1] == right[j - 1]):
                return np.concatenate([left[: len(left) - i], np.array(again, np.int64), right[j:]])
            window *= 2

    def _continues(self, token: int) -> bool:
        """Whether a token starts within a character."""
        return self.bytes_of[token][0] & 0xC0 == 0x80

    def _ends_in_space(self, tokens) -> bool:
        """Whether the last character of some tokens is white space, whose split depends on what follows."""
        return b"".join(map(self.bytes_of.__getitem__, tokens))[-4:].decode("utf-8", errors="ignore")[-1:].isspace()

    def encode_by_halves(self, text: str, leaf_chars: int) -> np.ndarray:
        """Tree concatenation within one process."""
        return self.concatenated([np.array(self.encode(p), np.int64) for p in halves(text, leaf_chars)])

    def concatenated(self, parts: list[np.ndarray]) -> np.ndarray:
        """Parts joined two by two, level by level."""
        while len(parts) > 1:
            pairs = [self.joined(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(parts) & ~1 :]
        return parts[0] if parts else np.zeros(0, np.int64)


def codec(path: str) -> Codec:
    return once_per_process(("codec", path), lambda: Codec(path))


def halves(text: str, leaf_chars: int) -> list[str]:
    if len(text) <= leaf_chars:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf_chars) + halves(text[middle:], leaf_chars)


def _n_parts(length, leaf_chars: int):
    """The power of two by which a text is cut into parts of at most ``leaf_chars``."""
    return F.expr(f"cast(power(2, ceil(log2(greatest({length} / {leaf_chars}, 1)))) as int)")


def encoded(docs: DataFrame, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text; null and empty texts have none.

    Short texts are encoded where they are read.  Parts of long ones are spread over all tasks and come
    together again by row (id, text hash and copy), so that repeated rows stay rows of their own.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = documents_of(docs)

    def encode():
        coder = codec(vocabulary)
        return lambda texts: [[coder.encode(t) for t in texts]]

    short = add_columns(rows.where(F.length("text") <= leaf_chars), "ids array<int>", encode, ["doc_id"])

    long = rows.where(F.length("text") > leaf_chars)
    n = _n_parts("length(text)", leaf_chars)
    parts = long.select("doc_id", F.sha2("text", 256).alias("hash"), n.alias("n"), "text")
    # Equal parts of the length, as repeated halving gives up to a character: borders at i * length / n.
    border = lambda i: F.floor(i.cast("long") * F.length("text") / F.col("n")).cast("int")
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    first, last = border(F.col("part")), border(F.col("part") + 1)
    parts = parts.select("doc_id", "hash", "n", "part", F.substring(F.col("text"), first + 1, last - first).alias("piece"))
    leaves = add_columns(parts.repartition("doc_id", "hash", "part"), "ids array<int>", encode, ["doc_id", "hash", "n", "part"], text="piece")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        coder = codec(vocabulary)
        by_part: dict[int, np.ndarray] = {}
        for part, ids in zip(table["part"].to_pylist(), table["ids"].combine_chunks(), strict=True):
            by_part.setdefault(part, np.asarray(ids.values, np.int64))
        whole = coder.concatenated([by_part[p] for p in sorted(by_part)])
        copies = table.num_rows // len(by_part)
        return pa.table({"doc_id": pa.array([key[0].as_py()] * copies, pa.int64()), "ids": pa.array([whole.astype(np.int32)] * copies, pa.list_(pa.int32()))})

    return short.unionByName(leaves.groupBy("doc_id", "hash").applyInArrow(join, "doc_id long, ids array<int>"))


def digests(docs: DataFrame, vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: encoded, then decoded again."""
    vocabulary = vocabulary or default_vocabulary()

    def digest(batches):
        coder = codec(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], []]
            for ids in batch.column(1):
                ids = ids.values.to_pylist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(coder.decimal(ids).encode()).hexdigest())
                out[2].append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(docs, vocabulary, leaf_chars).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded(ids: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    vocabulary = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        coder = codec(vocabulary)
        return column.map(coder.decode)

    return ids.select("doc_id", text("ids").alias("text"))
