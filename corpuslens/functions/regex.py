"""Regex dialect: rule patterns are written for Python's ``re`` and run in Java's engine.

``to_java`` restates the classes whose meaning differs (Unicode-aware ``\\w \\s \\d \\b``, a dot
that stops only at ``\\n``, a literal ``{``).  ``anchors`` finds text every match must contain,
which lets a scan skip the regex on most files with a plain ``contains``.
"""

from __future__ import annotations

import re

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_CLASSES = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d*,?\d*\})\??")
_ESCAPED_LITERALS = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(pattern: str):
    """Yield (kind, text): literal, escape, set, open, close, bar, dot, edge, quantifier."""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            follow = pattern[i + 1]
            if follow in "wsdWSDb":
                yield "escape", follow
            else:
                yield "literal", _ESCAPED_LITERALS.get(follow, follow)
            i += 2
        elif c == "[":
            end = i + 1
            if pattern[end] == "^":
                end += 1
            if pattern[end] == "]":
                end += 1
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            yield "set", pattern[i : end + 1]
            i = end + 1
        elif c == "(":
            head = re.match(r"\((?:\?[:=!]|\?<[=!])?", pattern[i:]).group()
            yield "open", head
            i += len(head)
        elif c in ")|.$^":
            yield {")": "close", "|": "bar", ".": "dot"}.get(c, "edge"), c
            i += 1
        else:
            quantifier = _QUANTIFIER.match(pattern, i)
            if quantifier and quantifier.group() not in ("{}", "{,}", "{"):
                yield "quantifier", quantifier.group()
                i = quantifier.end()
            else:
                yield "literal", c
                i += 1


def _set_to_java(text: str) -> str:
    inner = re.sub(r"\\([wsd])", lambda m: _CLASSES[m.group(1)], text[1:-1])
    # Java reads a bare '[' or '&&' inside a set as set algebra.
    inner = re.sub(r"(?<!\\)\[", r"\\[", inner)
    return f"[{inner}]"


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The Java pattern that matches what ``pattern`` matches in Python."""
    out = ["(?iu)"] if ignore_case else []
    for kind, text in _tokens(pattern):
        if kind == "literal":
            out.append("\\" + text if text in r"\.[]{}()*+-?^$|/&~#" else text)
        elif kind == "escape":
            if text == "b":
                out.append(_BOUNDARY)
            elif text.islower():
                out.append(f"[{_CLASSES[text]}]")
            else:
                out.append(f"[^{_CLASSES[text.lower()]}]")
        elif kind == "set":
            # A set that also holds a negated class is the "anything at all" idiom.
            out.append(r"[\s\S]" if re.search(r"\\[SWD]", text) else _set_to_java(text))
        elif kind == "dot":
            out.append(r"[^\n]")
        elif kind == "edge":
            out.append(r"(?=\n?\z)" if text == "$" else r"\A")
        else:
            out.append(text)
    return "".join(out)


def anchors(pattern: str, ignore_case: bool = False) -> list[str]:
    """Literals of which at least one occurs in every match; empty when there is none."""
    branches: list[list[str]] = [[""]]
    depth = 0
    group: list[str] | None = None
    finished_group: list[str] | None = None

    def cut():
        branches[-1].append("")

    for kind, text in _tokens(pattern):
        if kind != "quantifier":
            finished_group = None
        if kind == "open":
            depth += 1
            if depth == 1:
                cut()
                group = [""] if text in ("(", "(?:") else None
            else:
                group = None
        elif kind == "close":
            depth -= 1
            if depth == 0:
                cut()
                if group and all(group):
                    finished_group = list(group)
                    branches[-1].append(finished_group)  # any one of these
                    cut()
                group = None
        elif depth:
            if group is not None:
                if kind == "literal":
                    group[-1] += text
                elif kind == "bar":
                    group.append("")
                else:
                    group = None
        elif kind == "bar":
            branches.append([""])
        elif kind == "literal":
            branches[-1][-1] += text
        elif kind == "quantifier":
            if text[0] in "*?{":
                if finished_group is not None:
                    branches[-1].remove(finished_group)
                else:
                    branches[-1][-1] = branches[-1][-1][:-1]
            cut()
        else:
            cut()

    found: list[str] = []
    for runs in branches:
        plain = max((r for r in runs if isinstance(r, str)), key=len)
        choice = max(
            (r for r in runs if isinstance(r, list)), key=lambda r: min(map(len, r)), default=None
        )
        if choice and min(map(len, choice)) > max(len(plain), 2):
            found += choice
        elif plain:
            found.append(plain)
        else:
            return []
    found = list(dict.fromkeys(found))
    return [a.lower() for a in found] if ignore_case else found
