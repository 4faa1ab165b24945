"""Many literals, one pass: which of several hundred literals occur in a text.

Hundreds of ``contains`` calls read the text hundreds of times.  Here the literals form one regular
expression, a prefix tree tried at every position inside a lookahead, and ``regexp_extract_all``
reports which of them occur.  It needs a set in which no literal contains another, so that at most
one can start at a position; ``minimal_literals`` makes one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = 6  # children of a tree node above which they are split into character ranges


def minimal_literals(literals) -> tuple[list[str], dict[str, str]]:
    """A set without containment, and for every literal the longest member that it contains."""
    literals = set(literals)
    chosen: list[str] = []
    for literal in sorted(literals, key=lambda a: (len(a), a)):
        if not any(c in literal for c in chosen):
            chosen.append(literal)
    representative = {
        literal: max((c for c in chosen if c in literal), key=lambda c: (len(c), c))
        for literal in literals
    }
    return chosen, representative


def _escape(char: str) -> str:
    return "\\" + char if not char.isalnum() and char.isascii() and not char.isspace() else char


def _tree(literals: list[str]) -> str:
    """Alternation over a prefix tree; wide nodes first test a range of characters."""
    if literals == [""]:
        return ""
    children: dict[str, list[str]] = {}
    for literal in literals:
        children.setdefault(literal[0], []).append(literal[1:])
    branches = [(c, _escape(c) + _tree(sorted(rest))) for c, rest in sorted(children.items())]
    if len(branches) == 1:
        return branches[0][1]
    if len(branches) <= _WIDE:
        return "(?:" + "|".join(text for _, text in branches) + ")"
    size = max(2, round(len(branches) ** 0.5))
    parts = []
    for start in range(0, len(branches), size):
        part = branches[start : start + size]
        guard = "".join(_escape(c) for c, _ in part)
        parts.append(f"(?=[{guard}])(?:" + "|".join(text for _, text in part) + ")")
    return "(?:" + "|".join(parts) + ")"


def literal_search_pattern(minimal: list[str]) -> str:
    """Java pattern whose first group is the literal that starts at a position."""
    return f"(?=({_tree(sorted(minimal))}))"


def literals_found(text: Column, minimal: list[str]) -> Column:
    """Distinct literals of a minimal set that occur in a text."""
    if not minimal:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(literal_search_pattern(minimal)), 1))
