"""Secret scans: pattern matches, and encoded secrets confirmed by their structure.

``base_spans`` are plain pattern matches.  ``confirmed_spans`` look further: base64 and hex candidates are
decoded, and reported only if the bytes parse as what they claim to be:

- ``der``: a private key in DER (PKCS#1, SEC1, PKCS#8, encrypted PKCS#8), every nested length of which
  fits its parent exactly;
- ``pem``: a private-key block whose body decodes to such a key, to an OpenSSH key, or is marked encrypted;
- ``openssh``: an OpenSSH private key blob with consistent length-prefixed fields;
- ``nested``: base64 or hex, in one run or in lines of equal length, that decodes to any of these (a PEM file in
  base64, as in cluster manifests, hex of an OpenSSH key, a key wrapped in lines without its header), through
  at most ``LEVELS`` encodings; a run whose bytes are a key themselves keeps the key's kind;
- ``jwt``: a signed token whose header is a JSON object with a signature algorithm and whose signature
  has the length that the algorithm asks for.

Public keys, certificates and unsigned tokens are no secrets and are not reported.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame

from corpuslens.llm.common import add_columns, documents_of

KINDS = ["assign", "access", "hex", "der", "jwt", "nested", "openssh", "pem"]
LEVELS = 4
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # shorter runs hold no longer match
_HEX = re.compile(r"[0-9a-f]{24,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
# Lines of at least 40 characters and a last one of any length; the end of a line may be written out.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:(?:\r?\n|\\n)[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_HEX_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{40,}+(?:(?:\r?\n|\\n)[\x20\t]*+[0-9A-Fa-f]++)++(?![A-Za-z0-9+/_-])")
_LINE_END = re.compile(r"(?:\r?\n|\\n)[\x20\t]*")
_HEX_BYTES = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{24}")
_SIGNATURE_BYTES = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[at:end] exactly; None if they don't."""
    found = []
    while at < end:
        if at + 2 > end:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return None
            length, at = int.from_bytes(data[at : at + size], "big"), at + size
            if length < 0x80:
                return None  # not the shortest form
        if at + length > end:
            return None
        found.append((tag, at, at + length))
        at += length
    return found


def is_private_key(data: bytes) -> bool:
    """Whether DER bytes are a private key, down to the inner key of PKCS#8."""
    outer = _elements(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = _elements(data, outer[0][1], outer[0][2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    value = lambda i: data[parts[i][1] : parts[i][2]]
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: an algorithm and the bytes
        algorithm = _elements(data, *parts[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[1][2] - parts[1][1] >= 16
    if tags[0] != 0x02 or len(value(0)) != 1:
        return False
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1: version and eight numbers
        return value(0) in (b"\0", b"\1") and len(value(1)) >= 32
    if tags[:2] == [0x02, 0x04] and value(0) == b"\1":  # SEC1
        return len(value(1)) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [0x02, 0x30, 0x04] and value(0) in (b"\0", b"\1"):  # PKCS#8
        algorithm, inner = _elements(data, *parts[1][1:]), value(2)
        if not algorithm or algorithm[0][0] != 0x06:
            return False
        octets = _elements(inner, 0, len(inner))
        raw = bool(octets) and len(octets) == 1 and octets[0][0] == 0x04 and octets[0][2] - octets[0][1] in (32, 56, 57)
        return raw or is_private_key(inner) or bool(octets) and len(octets) == 1 and octets[0][0] == 0x02
    return False


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return data[at - size : at] if at <= len(data) else None

    if any(field() is None for _ in range(3)):  # cipher, key derivation, its options
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64 or any(field() is None for _ in range(keys)):
        return False
    secret = field()
    return secret is not None and len(secret) >= 16


def decoded(candidate: str) -> bytes:
    """Bytes of base64 in either alphabet, with or without padding; empty if it is none."""
    body = candidate.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_signed_token(token: str) -> bool:
    head, payload, signature = token.split(".")
    try:
        header, claims = json.loads(decoded(head)), json.loads(decoded(payload))
    except (ValueError, RecursionError):
        return False
    algorithm = header.get("alg") if isinstance(header, dict) else None
    if not isinstance(claims, dict) or not isinstance(algorithm, str) or algorithm.lower() == "none":
        return False
    size = len(decoded(signature))
    return size in _SIGNATURE_BYTES[algorithm] if algorithm in _SIGNATURE_BYTES else size >= 64 and bool(re.fullmatch("[RP]S(256|384|512)", algorithm))


def _armoured(text: str) -> list[tuple[str, int, int]]:
    spans = []
    begins = list(_BEGIN.finditer(text))
    for begin, limit in zip(begins, [*(b.start() for b in begins[1:]), len(text)], strict=False):
        footer = f"-----END {begin[1]}-----"
        end = text.find(footer, begin.end(), limit)
        if end < 0:
            continue
        body = text[begin.end() : end]
        data = decoded("".join(body.replace("\\n", "\n").split()))
        if is_private_key(data) or is_openssh_key(data) or "Proc-Type: 4,ENCRYPTED" in body:
            spans.append(("pem", begin.start(), end + len(footer)))
    return spans


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])] + _armoured(text)
    taken = [(s, e) for kind, s, e in spans]
    # Wrapped bodies before single runs, so that a line of a body is not looked at alone; hex before base64.
    for pattern, wrapped in ((_HEX_LINES, True), (_LINES, True), (_HEX_BYTES, False), (_BASE64, False)):
        for match in pattern.finditer(text):
            for start, end in _bodies(match) if wrapped else [match.span()]:
                kind = _kind(text[start:end], pattern in (_HEX_LINES, _HEX_BYTES), LEVELS)
                if kind and not any(s < end and start < e for s, e in taken):
                    spans.append((kind, start, end))
                    taken.append((start, end))
    return spans


def _bodies(match: re.Match) -> list[tuple[int, int]]:
    """Wrapped bodies of adjoining lines: each is lines of one length and then one that is not longer."""
    lines, at = [], match.start()
    for stop in [*_LINE_END.finditer(match.string, match.start(), match.end()), None]:
        lines.append((at, match.end() if stop is None else stop.start()))
        at = match.end() if stop is None else stop.end()
    bodies, first = [], 0
    size = lambda i: lines[i][1] - lines[i][0]
    while first < len(lines):
        last = first
        while last + 1 < len(lines) and size(last) == size(first) and size(last + 1) <= size(first):
            last += 1
        if last > first:
            bodies.append((lines[first][0], lines[last][1]))
        first = last + 1
    return bodies


def _kind(candidate: str, hexadecimal: bool, levels: int) -> str | None:
    """What an encoded run holds: a key, something encoded that holds one (``nested``), or nothing."""
    body = _LINE_END.sub("", candidate)
    data = (bytes.fromhex(body) if len(body) % 2 == 0 else b"") if hexadecimal else decoded(body)
    if data[:1] == b"0" and is_private_key(data):
        return "der"
    if is_openssh_key(data):
        return "openssh"
    # What is encoded once more is text; the first bytes tell it from the rest at once.
    if levels > 1 and len(data) >= 24 and _PLAIN.match(data) and data.isascii() and confirmed_in(data.decode("ascii"), levels - 1):
        return "nested"
    return None


def confirmed_in(text: str, levels: int) -> bool:
    """Whether decoded text holds a key, a signed token or a further encoding of one."""
    if _armoured(text) or any(is_signed_token(m[0]) for m in _TOKEN.finditer(text)):
        return True
    for pattern in (_HEX_LINES, _LINES, _HEX_BYTES, _BASE64):
        for match in pattern.finditer(text):
            parts = _bodies(match) if pattern in (_HEX_LINES, _LINES) else [match.span()]
            if any(_kind(text[s:e], pattern in (_HEX_LINES, _HEX_BYTES), levels) for s, e in parts):
                return True
    return False


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], _ORDER[x[0]], x[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): all spans of every whole text; null and empty texts have none.

    Offsets are code points, ends exclusive.  Nothing is shuffled; repeated rows give repeated rows.
    """

    def start():
        def scan(texts: list[str]) -> list[list]:
            base = [base_spans(t) for t in texts]
            spans = [joined(b + confirmed_spans(t)) for b, t in zip(base, texts, strict=True)]
            return [[joined(b) for b in base], spans, [[sum(x[0] == k for x in b) for k in KINDS[:3]] for b in base]]

        return scan

    return add_columns(documents_of(docs), "base string, spans string, counts array<long>", start, ["doc_id"])

