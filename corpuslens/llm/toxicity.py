"""Toxicity by multiple-instance learning: sentences are scored, only documents are labelled.

A document is toxic if any of its sentences is: its score is the noisy-or of the sentence scores,
1 - prod(1 - p).  A sentence's score is a logistic function of the words in it and of their stems (first
four to seven letters, marked ``~``), so that inflected forms count that no training text holds.  Words and weights are
learned from document labels alone, on at most ``TRAIN_ROWS`` labelled documents of the learning folds
(those with the smallest hashes of their ids); the words are those whose presence depends on the label.
The gradient of the noisy-or gives each sentence its share of the blame, so that sentence scores locate
what is toxic (``offending_sentences``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import add_columns, documents_of, held_out, smallest_hashes, written

TRAIN_ROWS = 10000
VOCABULARY = 2000
LEAST_DOCUMENTS = 4
LEAST_SHARE = 0.002
LEAST_CHI_SQUARE = 20.0
STEMS = range(4, 8)  # letters
STEPS = 400
SPARSITY = 3e-4

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Where sentences start and end; a text without any is one empty sentence."""
    return [m.span() for m in _SENTENCE.finditer(text)] or [(0, 0)]


def words(text: str) -> set[str]:
    """Words and stems."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:k] + "~" for w in found for k in STEMS if len(w) > k}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self) -> Callable[[str], list[tuple[int, int, float]]]:
        """A function that gives (start, end, score) of every sentence of a text."""
        heads: dict[str, list[tuple[str, bool, float]]] = {}
        for known, weight in self.weights.items():
            stem = known.endswith("~")
            heads.setdefault(known.rstrip("~")[: STEMS[0]], []).append((known.rstrip("~"), stem, weight))
        quiet = float(1 / (1 + np.exp(-self.bias)))

        def scored(text: str) -> list[tuple[int, int, float]]:
            found = []
            for start, end in sentences(text):
                hits = {}
                for word in _WORD.findall(text[start:end].lower()):
                    for known, stem, weight in heads.get(word[: STEMS[0]], ()):
                        if word == known and not stem or stem and len(word) > len(known) and word.startswith(known):
                            hits[known, stem] = weight
                found.append((start, end, float(1 / (1 + np.exp(-self.bias - sum(hits.values())))) if hits else quiet))
            return found

        return scored


def noisy_or(scored: list[tuple[int, int, float]]) -> float:
    rest = 1.0
    for _, _, p in scored:
        rest *= 1 - p
    return 1 - rest


def train(bags: list[list[list[int]]], silent: np.ndarray, labels: np.ndarray, n_words: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log loss of the noisy-or, by Adam with a pull to zero.

    ``bags``: for every document the sentences that hold known words, as word numbers; ``silent``: how many
    sentences hold none.
    """
    sentence_of, word, document = [], [], []
    for d, bag in enumerate(bags):
        for numbers in bag:
            sentence_of += [len(document)] * len(numbers)
            word += numbers
            document.append(d)
    sentence_of, word, document = np.array(sentence_of, int), np.array(word, int), np.array(document, int)
    weights = np.zeros(n_words + 1)
    weights[-1] = np.log(max(labels.mean(), 1e-3) / max((silent.sum() + len(document)) / len(bags), 1))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        margin = weights[-1] + np.bincount(sentence_of, weights[word], len(document))
        p, quiet = 1 / (1 + np.exp(-margin)), 1 / (1 + np.exp(-weights[-1]))
        # log(1 - P) of a document is the sum of log(1 - p); d loss / d margin = p * (1 - y / P)
        rest = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + silent * np.log1p(-quiet)
        whole = np.clip(-np.expm1(rest), 1e-9, 1)
        blame = 1 - labels / whole
        slope = p * blame[document]
        gradient = np.append(np.bincount(word, slope[sentence_of], n_words), slope.sum() + (silent * quiet * blame).sum()) / len(bags)
        gradient[:-1] += SPARSITY * np.sign(weights[:-1])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[:-1][np.abs(weights[:-1]) < 0.1] = 0
    return weights[:-1], float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from ``labels`` (doc_id, toxic); without labels of both kinds its scores are constant."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = smallest_hashes(marked, F.xxhash64("doc_id"), TRAIN_ROWS, "doc_id")  # bounded, so it may be sent to all tasks
    rows = documents_of(docs).join(F.broadcast(drawn), "doc_id")
    # Copies of a text teach once, with the label that most of them have.
    rows = rows.groupBy("text").agg(F.round(F.avg("toxic")).cast("int").alias("toxic"))

    def start():
        return lambda texts: [[[sorted(words(t[s:e])) for s, e in sentences(t)] for t in texts]]

    rows = written(add_columns(rows, "bag array<array<string>>", start, ["toxic"]), "toxicity")
    size, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < size:
        return Model({}, float(np.log((toxic + 0.5) / (size - toxic + 0.5))) if size else -20.0)

    # Words that depend on the label: chi-square of the two-by-two table, at most VOCABULARY of them.
    seen = rows.select("toxic", F.explode(F.array_distinct(F.flatten("bag"))).alias("word")).groupBy("word")
    seen = seen.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= max(LEAST_DOCUMENTS, LEAST_SHARE * size))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chi = size * (k * size - n * toxic) ** 2 / (n * (size - n + 1e-9) * toxic * (size - toxic))
    known = [r["word"] for r in seen.where(chi >= LEAST_CHI_SQUARE).orderBy(chi.desc(), "word").limit(VOCABULARY).collect()]
    if not known:
        return Model({}, float(np.log(toxic / (size - toxic))))

    number = F.create_map(*[F.lit(x) for i, w in enumerate(known) for x in (w, i)])
    inner = F.transform("bag", lambda s: F.transform(F.array_intersect(s, F.array(*map(F.lit, known))), lambda w: number[w]))
    bags = rows.select("toxic", F.size("bag").alias("sentences"), F.filter(inner, lambda s: F.size(s) > 0).alias("bag")).collect()
    silent = np.array([r["sentences"] - len(r["bag"]) for r in bags], float)
    weights, bias = train([r["bag"] for r in bags], silent, np.array([r["toxic"] for r in bags], float), len(known))
    return Model({w: float(x) for w, x in zip(known, weights, strict=True) if x}, bias)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; null and empty texts are one empty sentence.

    Learns from the rows outside the held-out fold.  Nothing but the text enters a score, so that equal
    texts have equal scores.
    """
    model = fit(docs, labels)

    def start():
        scored = model.scorer()
        return lambda texts: [[noisy_or(scored(t)) for t in texts]]

    rows = add_columns(documents_of(docs), "score double", start, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentences): start, end and score of the sentences scored ``least`` or more."""

    def start():
        scored = model.scorer()
        return lambda texts: [[[{"start": s, "end": e, "score": p} for s, e, p in scored(t) if p >= least] for t in texts]]

    return add_columns(documents_of(docs), "sentences array<struct<start:int,end:int,score:double>>", start, ["doc_id"])
