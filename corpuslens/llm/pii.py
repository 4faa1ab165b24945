"""Personal data: candidates proposed by wide patterns, judged by boosted trees, beside strict base patterns.

1. Generators with high recall propose overlapping candidate spans: mail-like (written-out "at" and "dot"
   included), dotted-number-like (written-out or bracketed dots included) and digit-group-like (whole chains
   of groups, their phone-shaped parts and their unbroken runs).
2. A candidate has features of its format (digits, groups, separators, marks, checksum, ...) and of its
   context (neighbouring characters and words).
3. ``fit`` trains gradient-boosted trees on the candidates of all texts.  Features are put into bins at exact
   quantiles and equal rows become one *cell* with a count.  A level of all trees needs sums per node, feature
   and bin: of cells that the driver holds, if they are at most ``CELLS_AT_ONCE``, else by one job over the
   written cells.  The sums are whole numbers, so that both ways and every order of the rows grow the same
   trees.  No row marks personal data, so the base patterns are the teachers.
   Each base match teaches as it stands and with its decisive mark masked: an address with "at" and "dot"
   written out or in brackets, an address of numbers with its dots written out, a phone number without its
   country code.  Contrasts of the same shapes are negative: words of the same text joined by "at" and
   "dot", numbers above 255, dates.  Candidates that a base pattern looks at and drops are negative;
   candidates that none of them can judge (written-out forms, parts of chains that are too long) teach
   nothing, because what the generators exist to find must not be taught as wrong.
4. Base matches in three are set apart with all their forms: the threshold of each kind is the lowest score, in
   steps of 1/``STEPS`` and at least one half, above which at least ``PRECISION`` of all that part's rows are positive.
5. Spans are all base matches, and the candidates above their threshold that overlap none of these, the
   best first, the longer of equals.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import add_columns, documents_of, materialize, written

CELLS_AT_ONCE = 1 << 18  # different binned rows that the driver holds at most
TREES = 60
DEPTH = 3
RATE = 0.2
PRECISION = 0.995
LEAST_CONFIRMED = 12  # positives set apart above a threshold, at least
BINS = 32
UNIT = 1 << 24  # slopes are whole multiples of its inverse
STEPS = 1 << 16
TREES_AT_ONCE = 10  # trees whose leaves a job adds up before the margins are written

KINDS = ["email", "ip", "card", "phone", "mail_like", "dotted_like", "digits_like"]
GENERATED = KINDS[4:]
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED_DOT = r"(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?|\x20dot\x20)"
_WIDE = [
    ("mail_like", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{{1,63}}(?:{_MARKED_DOT}[A-Za-z0-9-]{{1,63}})+")),
    ("dotted_like", re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_MARKED_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")),
    ("digits_like", re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")),
    ("digits_like", re.compile(r"(?<![0-9A-Za-z])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9A-Za-z])")),
    ("digits_like", re.compile(r"(?<![0-9A-Za-z])[0-9]{14,19}(?![0-9A-Za-z])")),
]
_WRITTEN = re.compile(r"[\[(](?:at|dot|\.)[\])]|\x20at\x20|\x20dot\x20")
_HINTS = re.compile(r"(?i)mail|phone|tel|call|fax|mobil|contact|card|visa|iban|account|addr|host|server|\bip\b")
_WORDS = re.compile(r"[A-Za-z]+")
AROUND = 24  # characters of context on either side
# Forms of the masked marks: "at" and "dot" of addresses, dots of numbers.
MASKS = [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "(dot)")]
_LETTERS = str.maketrans("0123456789", "aeioustnrl")
DOTS = ["[.]", " dot ", "(dot)", " [.] "]
FEATURES = [
    "length", "digits", "letters", "groups", "longest_group", "shortest_group", "spaces", "dots", "hyphens", "brackets", "plus", "at",
    "checksum", "largest_number", "last_letters", "before", "after", "hint", "digits_around", "marks_around",
    "first_zero", "bracketed", "written", "first_marks", "first_group", "last_group",
]


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches: from each @ the address before it is extended back to the last match at most."""
    spans, last = [], 0
    for domain in _DOMAIN.finditer(text):
        start = domain.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < domain.start():
            spans.append(("email", start, domain.end()))
            last = domain.end()
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = _emails(text) if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *match.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def candidates(text: str) -> list[tuple[str, int, int]]:
    return list(dict.fromkeys((kind, *m.span()) for kind, pattern in _WIDE for m in pattern.finditer(text)))


def _class(char: str) -> int:
    return 0 if not char else 1 if char.isspace() else 2 if char.isdigit() else 3 if char.isalpha() else 4


def features(text: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    marks = _WRITTEN.findall(span)
    spaced = sum(m[0] == " " for m in marks)
    return [
        len(span), len(digits), sum(c.isalpha() for c in span), len(groups), max(sizes), min(sizes), span.count(" "), span.count("."),
        span.count("-"), span.count("(") + span.count(")"), span.startswith("+"), "@" in span, bool(digits) and luhn(digits),
        max((min(int(g[:9]), 10**6) for g in groups), default=0), len(re.search("[A-Za-z]*$", span)[0]), _class(before[-1:]), _class(after[:1]),
        bool(_HINTS.search(before)), sum(c.isdigit() for c in before + after), sum(c in "{}=<>|&/\\#$%*" for c in before + after),
        digits.startswith("0"), len(marks) - spaced, spaced, sum(c in "0123456789._%+-" for c in re.match(r"[^\x20@\[(]*", span)[0]), sizes[0], sizes[-1],
    ]


def _same(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two spans share at least four fifths of what they cover."""
    shared = min(a[1], b[1]) - max(a[0], b[0])
    return 5 * shared >= 4 * (max(a[1], b[1]) - min(a[0], b[0]))


def _forms(kind: str, span: str, words: list[str]) -> list[tuple[str, int, str]]:
    """(kind, label, form): a base match with its decisive mark masked, and contrasts of the same shape.

    ``words`` are the three words of the text before the match, if there are as many.
    """
    if kind == "email":
        local, host = span.split("@")
        plain = [x.translate(_LETTERS) for x in (local, host)]
        short = ".".join(host.split(".")[-2:])
        shown = [(local, host), plain, (local, short), (plain[0], short)]  # with and without digits, with a short host
        forms = [("mail_like", 1, own + at + name.replace(".", dot)) for own, name in shown for at, dot in MASKS]
        if len(words) == 3:
            first, second, third = words
            forms += [("mail_like", 0, f"{first} at {second}{dot}{third}") for dot in (".", " dot ")]
            n = zlib.crc32(span.encode())
            forms += [("mail_like", 0, f"{second} at {third}.{first}.{second}"), ("mail_like", 0, f"{third} at {n % 24}.{n % 60:02}")]
            forms += [("mail_like", 0, f"{first}{n % 10} at {second}{dot}{third}") for dot in (".", " dot ")]
            forms += [("mail_like", 0, f"{second} at {third}{n % 100}{dot}{first}") for dot in (".", " dot ")]
        return forms
    if kind == "ip":
        parts = span.split(".")
        above = [*parts[:2], str(int(parts[2]) % 700 + 300), parts[3]]
        return [("dotted_like", label, dot.join(p)) for dot in DOTS for label, p in ((1, parts), (0, above))]
    code = re.match(r"\+[0-9]{1,3}[\x20.-]?", span)
    if kind == "phone" and code and sum(c.isdigit() for c in span[code.end() :]) >= 7:
        rest = span[code.end() :]
        a, b = int("".join(c for c in rest if c.isdigit())[-6:]), zlib.crc32(span.encode())
        day, month, year = f"{a % 28 + 1:02}", f"{b % 12 + 1:02}", 1900 + (a + b) % 140
        national = re.sub(r"^\(0*([0-9]+)\)[\x20.-]?", r"0\1-", rest) if rest[0] == "(" else "0" + rest.lstrip("0")
        shown = [rest, national, re.sub(r"[\x20().-]", "", national), re.sub(r"[\x20().-]+", " ", national)]
        dates = [f"{day}.{month}.{year}", f"{year}-{month}-{day}", f"{year}{month}{day}", f"{day}-{month}-{year} {b % 24:02}"]
        return [("digits_like", 1, x) for x in shown] + [("digits_like", 0, x) for x in dates]
    return []


def teaching_rows(text: str) -> list[tuple[str, int, int, list[float]]]:
    """(kind, label, apart, features) of the candidates that base patterns judge, and of masked matches and contrasts."""
    base = base_spans(text)
    chains = [m.span() for pattern in (_CARD, _PHONE) for m in pattern.finditer(text)]
    apart = lambda span: int(zlib.crc32(span.encode()) % 3 == 0)
    rows = []
    for kind, start, end in candidates(text):
        over = [(s, e) for _, s, e in base if s < end and start < e]
        label = int(bool(over))
        if over and not any(_same(o, (start, end)) for o in over):
            continue
        if not over and (_WRITTEN.search(text, start, end) or any(s <= start and end <= e and e - s > end - start for s, e in chains)):
            continue
        rows.append((kind, label, apart(text[start:end]), features(text, start, end)))
    for kind, start, end in base:
        before, after, span = text[max(0, start - AROUND) : start], text[end : end + AROUND], text[start:end]
        words = _WORDS.findall(text[max(0, start - 200) : start])[-3:]
        for form_kind, label, form in _forms(kind, span, words):
            rows.append((form_kind, label, apart(span), features(before + form + after, len(before), len(before) + len(form))))
    return rows


@dataclass(frozen=True)
class Trees:
    """Boosted trees of fixed depth over binned features; node i has the children 2i+1 and 2i+2."""

    nodes: np.ndarray  # (trees, inner nodes, 2): feature, threshold
    leaves: np.ndarray  # (trees, leaves)
    start: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        each = np.arange(len(rows))
        for nodes, leaves in zip(self.nodes, self.leaves, strict=True):
            at = np.zeros(len(rows), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[each, nodes[at, 0].astype(int)] > nodes[at, 1])
            total += leaves[at - len(nodes)]
        return 1 / (1 + np.exp(-total))


@dataclass
class Growing:
    """Trees of one kind over bins; ``splits`` has the feature and the last bin of the left side of every node."""

    edges: list[np.ndarray]
    start: float
    splits: list[np.ndarray]
    leaves: list[np.ndarray]

    def trees(self) -> Trees:
        value = lambda f, b: self.edges[f][b] if b < BINS else np.inf
        nodes = np.array([[(f, value(f, b)) for f, b in tree] for tree in self.splits], float)
        return Trees(nodes, np.array(self.leaves), self.start)


def _growing(edges: list[np.ndarray], positive: int, total: int) -> Growing:
    mean = np.clip(positive / total, 1e-3, 1 - 1e-3)
    return Growing(edges, float(np.log(mean / (1 - mean))), [], [])


def _binned(rows: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)


def _nodes(columns: np.ndarray, splits: np.ndarray, levels: int) -> np.ndarray:
    """The node that every binned row reaches after some levels."""
    at, each = np.zeros(len(columns), int), np.arange(len(columns))
    for _ in range(levels):
        at = 2 * at + 1 + (columns[each, splits[at, 0]] > splits[at, 1])
    return at


def _add_trees(margin: np.ndarray, columns: np.ndarray, model: Growing, first: int) -> None:
    """Adds the leaves of the trees from ``first`` on, one after another."""
    for splits, leaves in zip(model.splits[first:], model.leaves[first:], strict=True):
        margin += leaves[_nodes(columns, splits, DEPTH) - (2**DEPTH - 1)]


def _sums(columns: np.ndarray, labels: np.ndarray, counts: np.ndarray, margin: np.ndarray, splits: np.ndarray, level: int) -> np.ndarray:
    """Slopes and curvatures in units by node of the level, feature and bin."""
    p = 1 / (1 + np.exp(-margin))
    weights = counts * np.rint(UNIT * (labels - p)), counts * np.rint(UNIT * np.maximum(p * (1 - p), 1e-6))
    nodes, node = 2**level, _nodes(columns, splits, level) - (2**level - 1)
    out = np.zeros((2, nodes, columns.shape[1], BINS + 1))
    for f in range(columns.shape[1]):
        at = node * (BINS + 1) + columns[:, f]
        for part, weight in zip(out, weights, strict=True):
            part[:, f] = np.bincount(at, weight, nodes * (BINS + 1)).reshape(nodes, BINS + 1)
    return out


def _split(slope: np.ndarray, curve: np.ndarray, edges: list[np.ndarray]) -> tuple[tuple[int, int], list[float]]:
    """The best split of a node, second order, and the leaves on either side."""
    left_g, left_h = np.cumsum(slope, axis=1) / UNIT, np.cumsum(curve, axis=1) / UNIT
    g, h = left_g[0, -1], left_h[0, -1]
    gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
    gain[np.arange(BINS + 1) >= np.array([[len(e)] for e in edges])] = 0
    f, b = (int(x) for x in np.unravel_index(gain.argmax(), gain.shape))
    if gain[f, b] <= 1e-6:
        f, b = 0, BINS  # all rows go left
    sides = (left_g[f, b], left_h[f, b]), (g - left_g[f, b], h - left_h[f, b])
    return (f, b), [RATE * x / (y + 1) for x, y in sides]


def _boost(models: dict[str, Growing], sums: Callable[[dict[str, Growing], dict[str, np.ndarray], int], dict[str, np.ndarray]]) -> None:
    """Second-order boosting of the logistic loss, level by level, all kinds at once."""
    for _ in range(TREES):
        splits = {kind: np.zeros((2**DEPTH - 1, 2), int) for kind in models}
        leaves = {kind: [] for kind in models}
        for level in range(DEPTH):
            for kind, (slope, curve) in sums(models, splits, level).items():
                found = [_split(g, h, models[kind].edges) for g, h in zip(slope, curve, strict=True)]
                splits[kind][2**level - 1 : 2 ** (level + 1) - 1] = [x for x, _ in found]
                leaves[kind] = [x for _, sides in found for x in sides]
        for kind, model in models.items():
            model.splits.append(splits[kind])
            model.leaves.append(np.array(leaves[kind]))


def _held(cells: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Sums over cells (binned rows, labels, counts) in memory."""
    margins: dict[str, np.ndarray] = {}

    def sums(models: dict[str, Growing], splits: dict[str, np.ndarray], level: int) -> dict[str, np.ndarray]:
        for kind, model in models.items():
            if kind not in margins:
                margins[kind] = np.full(len(cells[kind][0]), model.start)
            elif level == 0:
                _add_trees(margins[kind], cells[kind][0], model, len(model.splits) - 1)
        return {kind: _sums(*cells[kind], margins[kind], splits[kind], level) for kind in models}

    return sums


def _by_kind(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
    """The rows of each kind and their bins."""
    for kind in batch.column("kind").unique().to_pylist():
        own = batch.filter(pa.compute.equal(batch.column("kind"), kind))
        yield kind, own, np.frombuffer(b"".join(own.column("bins").to_pylist()), np.uint8).reshape(own.num_rows, -1)


def _spread(cells: DataFrame):
    """Sums over cells (kind, label, bins, n) by a job each; margins are written from time to time."""
    state = {"cells": cells.withColumn("margin", F.lit(None).cast("double")), "trees": 0}

    def margins(own: pa.RecordBatch, columns: np.ndarray, model: Growing, first: int) -> np.ndarray:
        margin = np.full(own.num_rows, model.start) if first == 0 else own.column("margin").to_numpy(zero_copy_only=False).copy()
        _add_trees(margin, columns, model, first)
        return margin

    def sums(models: dict[str, Growing], splits: dict[str, np.ndarray], level: int) -> dict[str, np.ndarray]:
        first, grown = state["trees"], len(next(iter(models.values())).splits)

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kind, own, columns in _by_kind(batch):
                    yield own.set_column(own.schema.get_field_index("margin"), "margin", pa.array(margins(own, columns, models[kind], first), pa.float64()))

        if grown - first == TREES_AT_ONCE:
            state.update(cells=written(state["cells"].mapInArrow(advance, state["cells"].schema), "pii-margins"), trees=grown)
            first = grown

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for kind, own, columns in _by_kind(batch):
                    labels, counts = (own.column(c).to_numpy().astype(float) for c in ("label", "n"))
                    total[kind] = total.get(kind, 0) + _sums(columns, labels, counts, margins(own, columns, models[kind], first), splits[kind], level)
            for kind, (slope, curve) in total.items():
                some = np.flatnonzero(curve)
                columns = [pa.array([kind] * len(some), pa.string()), pa.array(some, pa.int32()), *(pa.array(x.ravel()[some].astype(np.int64)) for x in (slope, curve))]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "at", "slope", "curve"])

        found = state["cells"].mapInArrow(run, "kind string, at int, slope long, curve long")
        found = found.groupBy("kind", "at").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve")).toPandas()  # bounded by nodes, features and bins
        out = {}
        for kind in models:
            own, out[kind] = found[found.kind == kind], np.zeros((2, 2**level, len(models[kind].edges), BINS + 1))
            for part, name in zip(out[kind], ("slope", "curve"), strict=True):
                part.ravel()[own["at"].to_numpy()] = own[name].to_numpy()
        return out

    return sums


def boosted_trees(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted trees of rows in memory, splits at quantiles."""
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[:-1])) for f in range(rows.shape[1])]
    models = {"": _growing(edges, int(labels.sum()), len(labels))}
    _boost(models, _held({"": (_binned(rows, edges), labels, np.ones(len(rows)))}))
    return models[""].trees()


@dataclass(frozen=True)
class Model:
    trees: dict[str, Trees]
    thresholds: dict[str, float]

    def selected(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates above their threshold that overlap neither a base span nor a better candidate."""
        found = [c for c in candidates(text) if c[0] in self.thresholds and not any(s < c[2] and c[1] < e for _, s, e in base)]
        if not found:
            return []
        scores = [float(self.trees[k].scores(np.array([features(text, s, e)], float))[0]) for k, s, e in found]
        chosen: list[tuple[str, int, int]] = []
        for score, (kind, start, end) in sorted(zip(scores, found, strict=True), key=lambda x: (-x[0], x[1][1], -x[1][2])):
            if score >= self.thresholds[kind] and not any(s < end and start < e for _, s, e in chosen):
                chosen.append((kind, start, end))
        return chosen


def threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float | None:
    """The lowest score above which the candidates are positive often enough, if enough are confirmed."""
    counts = np.ones(len(scores)) if counts is None else counts
    order = np.argsort(-scores, kind="stable")
    right, every = np.cumsum((labels * counts)[order]), np.cumsum(counts[order])
    last = np.append(scores[order][1:] != scores[order][:-1], True)  # of equal scores
    good = np.flatnonzero(last & (right >= PRECISION * every) & (right >= LEAST_CONFIRMED))
    return float(scores[order][good[-1]]) if len(good) else None


def _edges(rows: DataFrame) -> dict[str, list[np.ndarray]]:
    """Exact quantiles of every feature over all rows that teach; its values are whole numbers up to 10**6 or lengths."""
    shares = F.array(*[F.lit(float(x)) for x in np.linspace(0, 1, BINS + 1)[:-1]])
    found = rows.groupBy("kind").agg(F.array(*[F.percentile(F.get("features", F.lit(i)), shares) for i in range(len(FEATURES))]).alias("edges"))
    return {r["kind"]: [np.unique(e) for e in r["edges"]] for r in found.collect()}


def fit(docs: DataFrame, cells_at_once: int = CELLS_AT_ONCE) -> Model:
    """Trees and thresholds from the candidates of all texts."""

    def start():
        return lambda texts: [[teaching_rows(t) for t in texts]]

    rows = add_columns(documents_of(docs), "rows array<struct<kind:string,label:int,apart:int,features:array<double>>>", start, ["doc_id"])
    rows = materialize(rows.where(F.size("rows") > 0).select(F.inline("rows")), "pii-candidates")
    edges = _edges(rows.where("apart = 0"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in set(batch.column("kind").to_pylist()) & set(edges):
                own = batch.filter(pa.compute.equal(batch.column("kind"), kind))
                bins = _binned(own.column("features").flatten().to_numpy().reshape(own.num_rows, -1), edges[kind])
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("kind", "label", "apart")), pa.array([x.tobytes() for x in bins], pa.binary())], names=["kind", "label", "apart", "bins"])

    cells = rows.mapInArrow(binned, "kind string, label int, apart int, bins binary")
    cells = written(cells.groupBy("kind", "label", "apart", "bins").agg(F.count("*").alias("n")), "pii-cells")
    found = {(r["kind"], r["apart"], r["label"]): r for r in cells.groupBy("kind", "apart", "label").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).collect()}
    taught = [k for k in GENERATED if (k, 0, 0) in found and (k, 0, 1) in found]
    models = {k: _growing(edges[k], found[k, 0, 1]["n"], found[k, 0, 0]["n"] + found[k, 0, 1]["n"]) for k in taught}
    if not models:
        return Model({}, {})
    teaching = cells.where(F.col("kind").isin(taught) & (F.col("apart") == 0)).select("kind", "label", "bins", "n")
    if sum(found[k, 0, y]["cells"] for k in taught for y in (0, 1)) <= cells_at_once:
        held = {kind: (columns, *(own.column(c).to_numpy().astype(float) for c in ("label", "n"))) for kind, own, columns in _by_kind(teaching.toArrow().combine_chunks().to_batches()[0])}
        _boost(models, _held(held))
    else:
        _boost(models, _spread(teaching))
    trees = {kind: model.trees() for kind, model in models.items()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, own, columns in _by_kind(batch):
                margin = np.full(own.num_rows, models[kind].start)
                _add_trees(margin, columns, models[kind], 0)
                step = np.floor(STEPS / (1 + np.exp(-margin))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own.column("kind"), own.column("label"), pa.array(step), own.column("n")], names=["kind", "label", "step", "n"])

    apart = cells.where(F.col("kind").isin(taught) & (F.col("apart") == 1)).mapInArrow(scored, "kind string, label int, step long, n long")
    apart = apart.groupBy("kind", "step", "label").agg(F.sum("n").alias("n")).toPandas()  # at most two rows per kind and step
    thresholds = {}
    for kind in taught:
        own = apart[apart.kind == kind]
        limit = threshold(own.step.to_numpy(float) / STEPS, own.label.to_numpy(float), own.n.to_numpy(float)) if len(own) else None
        if limit is not None:
            thresholds[kind] = max(limit, 0.5)
    return Model(trees, thresholds)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], _ORDER[x[0]], x[2])))


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, base, spans, counts): spans of every whole text; null and empty texts have none.

    Offsets are code points, ends exclusive.  Repeated rows give repeated rows.
    """
    model = model or fit(docs)

    def start():
        def scan(texts: list[str]) -> list[list]:
            base = [base_spans(t) for t in texts]
            spans = [joined(b + model.selected(t, b)) for b, t in zip(base, texts, strict=True)]
            return [[joined(b) for b in base], spans, [[sum(x[0] == k for x in b) for k in KINDS[:4]] for b in base]]

        return scan

    return add_columns(documents_of(docs), "base string, spans string, counts array<long>", start, ["doc_id"])


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones joined, replaced by the kind of its first."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, all columns kept, with personal data in ``text`` replaced by its kind.

    A null text stays null; every other column is left as it is.
    """
    model = model or fit(docs)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            clean = [t if t is None else redacted(t, (b := base_spans(t)) + model.selected(t, b)) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
