import hashlib
import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from corpuslens.llm import bpe

ALPHABETS = ["abc the re's stllve '' ", "  \n\t ab", "0123 ", "éß漢字😀 a", "'sdt re", "aaaaaaaa", "xy \xa0 z"]


def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_tree_concatenation_equals_whole_encoding():
    rnd, tokenizer, coder = random.Random(1), reference(), bpe.codec(bpe.default_vocabulary())
    for _ in range(1200):
        alphabet = rnd.choice(ALPHABETS)
        text = "".join(rnd.choice(alphabet) if rnd.random() < 0.9 else rnd.choice(["<|endoftext|>", "<|endof", " the", "ing", "  "]) for _ in range(rnd.randint(0, 400)))
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode_by_halves(text, rnd.choice([3, 17, 60])).tolist() == expected
        assert coder.decode(expected) == tokenizer.decode(expected, skip_special_tokens=False)


def expected_digests(rows):
    tokenizer = reference()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        yield doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_digests_of_edge_rows(edge_docs, edge_rows):
    got = Counter(tuple(r) for r in bpe.digests(edge_docs, leaf_chars=50).collect())
    assert got == Counter(expected_digests(edge_rows))


def test_round_trip_and_empty_table(sf001, no_docs):
    texts = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(sf001, leaf_chars=1000)).collect()}
    assert texts == {r["doc_id"]: r["text"] for r in sf001.collect()}
    assert bpe.digests(no_docs).count() == 0
