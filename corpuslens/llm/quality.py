"""Quality rules: statistics of every text, isolation forests over them, thresholds from labelled rows.

1. ``rule_statistics``: one pass over the texts, without a shuffle.
2. ``fit``: one isolation forest per family of rules (``FAMILIES``) on a bounded sample (``SAMPLE_ROWS``
   rows with the smallest hashes of the whole table).  Each tree splits random features at random values
   over ``TREE_ROWS`` rows; a row's anomaly score is 2 to the power of minus its mean path length over
   the length expected by chance.  Thresholds are read from histograms over all labelled rows: for each
   family the value with the best difference between the shares of bad and good rows above it, among
   those that reject at most ``MAX_GOOD_LOSS`` of the good ones and ``MIN_LIFT`` times as large a share
   of the bad ones; a family without such a value rejects nothing.
3. ``verdicts``: a row is kept if the base rules pass and no score reaches its threshold.

Without labels of both kinds there is no threshold, and only the base rules reject.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import add_columns, documents_of, materialize, smallest_hashes

SAMPLE_ROWS = 8192
TREES = 100
TREE_ROWS = 256
BINS = 1000
MAX_GOOD_LOSS = 0.005
MIN_LIFT = 10
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Further counts that the forest sees beside the base statistics.
MORE = "n_chars long, n_lines long, n_upper long, n_digits long, n_distinct long, n_marks long"
COUNTS = [x.split()[0] for x in f"{BASE}, {MORE}".split(", ")]
#: Features of each forest, by the rules that they stand for.
FAMILIES = {
    "symbols": ["symbols"], "case": ["upper"], "repetition": ["repeated_lines", "repeated_words", "distinct"],
    "shape": ["word_length", "line_words", "digits", "marks"],
}

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")
_MARKS = re.compile(r"[.,;:!?]")
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words which occurs twice or more in the list."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, total = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + size - max(at, covered)
            covered = at + size
    return total


def statistics(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # bytes split at ASCII white space alone
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if line.translate(_SPACES):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    return (
        len(words), len(text.translate(_SPACES)), len(_SYMBOLS.findall(text)), duplicates, repeated_words(words),
        len(text), lines, len(_UPPER.findall(text)), len(_DIGITS.findall(text)), len(set(words)), len(_MARKS.findall(text)),
    )


def _start():
    return lambda texts: list(zip(*map(statistics, texts), strict=True)) if texts else [[] for _ in COUNTS]


def rule_statistics(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The counts of every text beside the columns named in ``keep``."""
    return add_columns(rows, f"{BASE}, {MORE}", _start, keep)


def base_failed():
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features(counts: pd.DataFrame) -> dict[str, np.ndarray]:
    """The columns of each family's forest."""
    words = np.maximum(counts["n_words"].to_numpy(float), 1)
    chars = np.maximum(counts["word_chars"].to_numpy(float), 1)
    lines = np.maximum(counts["n_lines"].to_numpy(float), 1)
    per = lambda name, of: counts[name].to_numpy(float) / of
    values = {
        "symbols": per("n_symbols", chars), "upper": per("n_upper", chars), "digits": per("n_digits", chars),
        "repeated_lines": per("n_dup_lines", lines), "repeated_words": per("n_repeat_words", words),
        "distinct": np.log(per("n_distinct", words) + 1e-3), "word_length": chars / words,
        "line_words": np.log(words / lines), "marks": per("n_marks", words),
    }
    return {family: np.column_stack([values[n] for n in names]) for family, names in FAMILIES.items()}


def _expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _grow(rows: np.ndarray, rng: np.random.Generator, depth: int, nodes: list) -> int:
    """Appends (feature, value, left, right); a leaf has feature -1 and its path length as value."""
    at, spread = len(nodes), np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
    nodes.append(None)
    if depth == 0 or len(rows) <= 1 or not spread.any():
        nodes[at] = (-1, _expected_path(len(rows)), at, at)
        return at
    feature = int(rng.choice(np.flatnonzero(spread)))
    value = float(rng.uniform(rows[:, feature].min(), rows[:, feature].max()))
    lower = rows[:, feature] < value
    left, right = _grow(rows[lower], rng, depth - 1, nodes), _grow(rows[~lower], rng, depth - 1, nodes)
    nodes[at] = (feature, value, left, right)
    return at


@dataclass(frozen=True)
class Forest:
    trees: tuple[np.ndarray, ...] = ()
    tree_rows: int = 0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1; 0 without trees."""
        if not self.trees:
            return np.zeros(len(rows))
        depth = np.zeros(len(rows))
        for tree in self.trees:
            at, feature = np.zeros(len(rows), int), tree[:, 0].astype(int)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                lower = rows[inner, feature[here]] < tree[here, 1]
                at[inner] = np.where(lower, tree[here, 2], tree[here, 3]).astype(int)
                depth[inner] += 1
            depth += tree[at, 1]
        return 2.0 ** (-depth / len(self.trees) / max(_expected_path(self.tree_rows), 1e-9))


def isolation_forest(sample: np.ndarray, seed: int = 7) -> Forest:
    rng, size = np.random.default_rng(seed), min(TREE_ROWS, len(sample))
    trees = []
    for _ in range(TREES if size > 1 else 0):
        nodes: list = []
        _grow(sample[rng.choice(len(sample), size, replace=False)], rng, math.ceil(math.log2(size)), nodes)
        trees.append(np.array(nodes, float))
    return Forest(tuple(trees), size)


@dataclass(frozen=True)
class Model:
    forests: dict[str, Forest]
    thresholds: dict[str, int]  # the lowest bin that is rejected

    def bins(self, counts: pd.DataFrame) -> np.ndarray:
        """Anomaly scores in ``BINS`` steps, one column per family."""
        columns = features(counts)
        return np.column_stack([np.ceil(self.forests[f].scores(columns[f]) * BINS).astype(int) for f in FAMILIES])

    def anomalous(self, bins: np.ndarray) -> np.ndarray:
        return (bins >= np.array([self.thresholds.get(f, BINS + 1) for f in FAMILIES])).any(axis=1)


def _with_bins(counts: DataFrame, model: Model) -> DataFrame:
    @F.pandas_udf("array<int>")
    def bins(block: pd.DataFrame) -> pd.Series:
        return pd.Series(list(model.bins(block)))

    return counts.withColumn("anomaly", bins(F.struct(*COUNTS)))


def threshold(bins: dict[tuple[int, int], int]) -> int | None:
    """The lowest rejected bin from counts of labelled rows by (bin, label), if one is worth it."""
    good, bad = sum(n for (_, q), n in bins.items() if q == 1), sum(n for (_, q), n in bins.items() if q == 0)
    if not good or not bad:
        return None
    best, lost, caught, found = 0.0, 0, 0, None
    for at in range(BINS, 0, -1):
        lost, caught = lost + bins.get((at, 1), 0), caught + bins.get((at, 0), 0)
        if lost > MAX_GOOD_LOSS * good:
            break
        gain = caught / bad - lost / good
        if gain > best and caught / bad >= MIN_LIFT * lost / good:
            best, found = gain, at
    return found


def fit(counts: DataFrame, labels: DataFrame) -> Model:
    """Forests and thresholds from written statistics (with doc_id) and ``labels`` (doc_id, quality)."""
    passed = counts.where(~base_failed())
    drawn = smallest_hashes(passed.select("doc_id", *COUNTS), F.xxhash64("doc_id", *COUNTS), SAMPLE_ROWS, "doc_id", *COUNTS)
    drawn = drawn.select("doc_id", *COUNTS).toPandas().sort_values(["doc_id", *COUNTS])[COUNTS]
    forests = {family: isolation_forest(rows) for family, rows in features(drawn).items()}
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    scored = _with_bins(passed.join(marked, "doc_id"), Model(forests, {}))
    found = scored.select("quality", F.posexplode("anomaly").alias("family", "bin")).groupBy("family", "bin", "quality").count().collect()
    limits = {}
    for at, family in enumerate(FAMILIES):  # at most 2,002 counts each
        limit = threshold({(r["bin"], r["quality"]): r["count"] for r in found if r["family"] == at})
        if limit is not None:
            limits[family] = limit
    return Model(forests, limits)


def verdicts(counts: DataFrame, model: Model) -> DataFrame:
    """base_failed, anomaly (score per family, in thousandths) and kept beside the statistics."""
    limits = [F.get("anomaly", F.lit(at)) >= model.thresholds[f] for at, f in enumerate(FAMILIES) if f in model.thresholds]
    anomalous = reduce(lambda a, b: a | b, limits, F.lit(False))
    failed = base_failed()
    return _with_bins(counts, model).withColumn("base_failed", failed).withColumn("kept", ~failed & ~anomalous)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every document; null and empty texts have no words and fail the base rules.

    Repeated rows are judged alike; a document labelled more than once counts with its lowest label.
    """
    counts = materialize(rule_statistics(documents_of(docs), ["doc_id"]), "quality")
    model = fit(counts, labels)
    return verdicts(counts, model).select("doc_id", *[x.split()[0] for x in BASE.split(", ")], "base_failed", "kept", "anomaly")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns: two passes, no shuffle of texts."""
    counts = materialize(rule_statistics(documents_of(docs), ["doc_id"]), "quality")
    model = fit(counts, labels)

    def start():
        def judge(texts: list[str]) -> list[list]:
            block = pd.DataFrame([statistics(t) for t in texts], columns=COUNTS)
            bad = (block.n_words < MIN_WORDS) | (100 * block.n_repeat_words > MAX_REPEAT_PERCENT * block.n_words)
            if len(block):
                bad |= model.anomalous(model.bins(block))
            return [list(~bad)]

        return judge

    return add_columns(docs, "", start, keep_rows=True)
