import random
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import token_files as tf


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tf.default_vocabulary())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def brute(rows, library):
    """(doc_id, start, n_tokens, crc) of each row, where the order among rows of an id is free: ids per doc_id."""
    return [(d, np.array([*library(t or ""), 1], "<u4")) for d, t in rows]


def check(got, rows, library):
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    expected = sorted(((d is not None, d or 0, len(ids), zlib.crc32(ids.tobytes())) for d, ids in brute(rows, library)))
    assert sorted((d is not None, d or 0, n, crc) for d, _, n, crc in got) == expected


@pytest.mark.parametrize("values", [
    [], [0], [5] * 1000, list(range(-700, 700)), [2**63 - 1, -(2**63)] * 300, [1, 2, 3] * 400 + [2**40], [0] * 511 + [2**63 - 1], [7] * 512 + [9],
])
def test_streams_come_back(values):
    stream = tf.pack(np.array(values, np.int64))
    assert tf.unpack(stream).tolist() == values
    for first, last in [(0, 1), (511, 513), (3, 9), (len(values) - 1, len(values) + 5)]:
        first = max(first, 0)
        assert tf.unpack(stream, first, last).tolist() == values[first:last]


def test_random_streams_and_sizes():
    rnd = np.random.default_rng(3)
    for bits in range(1, 63, 7):
        values = rnd.integers(0, 1 << bits, 3000) - (1 << (bits - 1))
        values[rnd.integers(0, 3000, 40)] = rnd.integers(-(1 << 62), 1 << 62, 40)
        assert (tf.unpack(tf.pack(values)) == values).all()
    narrow = np.concatenate([rnd.integers(0, 64, 5000), [1 << 30]])
    assert len(tf.pack(narrow)) < len(narrow) * 6 / 8 * 1.1  # outliers do not widen a block


def test_word_encoder_equals_the_library(library):
    rnd = random.Random(4)
    coder = tf.WordEncoder(tf.default_vocabulary())
    letters = "abcXYZ'sdmtrvel0129,.!?<>|\"#$ \t\n\r\x0b\x1c\x85\xa0ÀéßÿªµÅÖ×÷ǅΣς́̈가漢😀ﬁ½²İıſK一 ​\x00\x7f"
    texts = ["", " ", "it's WE'LL 'tis don't'", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "<|endo ftext|>", "é É", "A\nb  c\t\td", "x" * 5000, "...'s'll''"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library(text), repr(text)


def test_simple_words_use_the_verified_codec(library):
    coder = tf.WordEncoder(tf.default_vocabulary())
    assert coder.of_words is not None
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(rnd.randint(1, 14))) for _ in range(20_000)] + ["aaaaaaa", "mmmmmmmmm", "ingingin", "!?!?...", "--"]
    assert np.frombuffer(coder.encode(" ".join(words)), "<u4").tolist() == library(" ".join(words))


def test_a_full_cache_is_cleared(library, monkeypatch):
    monkeypatch.setattr(tf, "CACHED_WORDS", 5)
    coder = tf.WordEncoder(tf.default_vocabulary())
    for text in ["one two three", "two four five six", "one two three four five six seven eight", "one"]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library(text)


def test_documents(sf001, library):
    check(tf.token_file_digests(sf001, segment_ids=5000).collect(), [(r["doc_id"], r["text"]) for r in sf001.collect()], library)


def test_edge_rows(edge_docs, edge_rows, no_docs, library):
    check(tf.token_file_digests(edge_docs, segment_ids=10).collect(), edge_rows, library)
    check(tf.token_file_digests(edge_docs).collect(), edge_rows, library)
    assert tf.token_file_digests(no_docs).columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and tf.token_file_digests(no_docs).count() == 0


def test_ranges_and_text(spark, tmp_path, sf001, library):
    target = f"file://{tmp_path}/{uuid.uuid4().hex}"
    tf.write_tokens(sf001, target, segment_ids=3000)
    index = tf.write_index(spark, target)
    rows = sorted((r["doc_id"], r["text"]) for r in sf001.collect())
    whole = [i for d, t in rows for i in [*library(t or ""), 1]]
    assert index.agg({"n_ids": "sum"}).first()[0] == len(whole) and index.count() > 5
    for first, length in [(0, 10), (2990, 7000), (len(whole) - 5, 50), (len(whole), 4)]:
        got = sorted(map(tuple, tf.read_range(spark, target, first, length).collect()))
        assert got == list(enumerate(whole))[first : first + length]
