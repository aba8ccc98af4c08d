"""Secret scans by assignment-aware lexing.

Base patterns find assigned secrets, access keys and long hexadecimal runs. On top, texts that mention a sensitive name are lexed as source
or configuration: ``name = value``, ``"name": value``, ``name := value``, ``name => value``, ``<name>value</name>`` and ``--name value`` become pairs of a
name and the literals of its value; string concatenation (over line ends too), variable references and ``${name}`` are resolved with the
constants assigned so far; and a literal that reaches a sensitive target is scored by the name and by
its own shape (length, character classes, entropy, no placeholder), as are all literals of a value joined. Those that score enough are added as kind ``named``.
Names and values have any length and any number of literals; every step of the lexer is linear in the text.

Defined cases: null counts as empty; offsets are code points of the whole text, ends exclusive; spans of different kinds may overlap;
repeated rows give the same result each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<n_assign: long, n_access: long, n_hex: long, base: string, spans: string>"
KINDS = ("assign", "access", "hex", "named")

# The base patterns; the first is matched on lower-cased bytes.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need no dropping

# Sensitive name parts and how telling they are; every part contains one of STEMS.
SENSITIVE = {
    b"password": 1.0, b"passwd": 1.0, b"pwd": 0.9, b"passphrase": 1.0, b"secret": 1.0, b"token": 0.9, b"apikey": 1.0,
    b"api_key": 1.0, b"access_key": 0.9, b"private_key": 1.0, b"secret_key": 1.0, b"credential": 0.9, b"credentials": 0.9,
    b"auth": 0.7, b"authorization": 0.8, b"client_secret": 1.0, b"encryption_key": 0.9, b"signing_key": 0.9,
}
STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"cred", b"auth")
PLACEHOLDERS = (b"example", b"changeme", b"placeholder", b"xxxx", b"****", b"dummy", b"<", b"todo")
EMPTY_WORDS = {b"none", b"null", b"true", b"false", b"your"}  # as whole words of a literal
THRESHOLD = 0.6

OPERATOR = re.compile(rb":=|=>|=(?![=>])|:(?!//)")
BLANKS = re.compile(rb"[ \t]*+")
NAME_BYTES, NO_FIRST = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-", b"0123456789.-"
PIECE = re.compile(rb"""[bru]?"(?P<d>(?:[^"\\\n]|\\.)*+)"|[bru]?'(?P<s>(?:[^'\\\n]|\\.)*+)'|\$\{?(?P<ref>[A-Za-z_][A-Za-z0-9_.]*+)\}?|(?P<bare>[A-Za-z0-9+/_.@%!-]++={0,2})""")
INSIDE = re.compile(rb"\$\{?([A-Za-z_][A-Za-z0-9_.]*+)\}?")
PLUS = re.compile(rb"[ \t\r\n]*+(?:\+|\.\.)[ \t\r\n]*+")
TAG = re.compile(rb"<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<>\s]++)</")
OPTION = re.compile(rb"(?<![A-Za-z0-9_-])--?([A-Za-z][A-Za-z0-9_-]*+)[ \t]++([^\s\"'-][^\s\"']*+)")

Span = tuple[int, int]


def sensitivity(name: bytes) -> float:
    """Weight of a target name: of its whole, its last two parts or any single part."""
    parts = [p for p in re.split(rb"[_.-]+", re.sub(rb"(?<=[a-z0-9])(?=[A-Z])", b"_", name).lower()) if p]
    pairs = [b"_".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)


def shape(literal: bytes) -> float:
    """How much a literal looks like a secret: 0 for short texts and placeholders, up to 1."""
    low = literal.lower()
    if len(literal) < 8 or any(p in low for p in PLACEHOLDERS) or b" " in literal or not EMPTY_WORDS.isdisjoint(re.split(rb"[^a-z0-9]+", low)):
        return 0.0
    entropy = -sum(c / len(literal) * math.log2(c / len(literal)) for c in Counter(literal).values())
    kinds = sum(bool(re.search(k, literal)) for k in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.5) * (0.7 + 0.1 * kinds)


class _Constant:
    """What a name was assigned: spans of literals and earlier constants, in order. Kept as a graph, so that values built of values cost no more than their text."""

    def __init__(self):
        self.parts: list[Span | _Constant] = []

    def literals(self) -> list[Span]:
        """Every literal once, in order of first use."""
        found: dict[Span, None] = {}
        seen, stack = {id(self)}, [iter(self.parts)]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, tuple):
                found[part] = None
            elif id(part) not in seen:
                seen.add(id(part))
                stack.append(iter(part.parts))
        return list(found)


def _value(text: bytes, at: int, known: dict[bytes, _Constant]) -> tuple[_Constant, int]:
    """What the expression at an offset evaluates to, and where the search for pairs goes on: after it, or where its first bare word starts, which may hold pairs itself."""
    found, bare = _Constant(), None
    while piece := PIECE.match(text, at):
        kind = piece.lastgroup
        if kind == "ref":
            found.parts += [known[piece["ref"]]] if piece["ref"] in known else []
        elif kind == "bare" and piece["bare"] in known:
            found.parts.append(known[piece["bare"]])
        else:
            found.parts.append(piece.span(kind))
            if kind == "bare":
                bare = piece.start() if bare is None else bare
            else:
                found.parts += [known[inner[1]] for inner in INSIDE.finditer(piece[kind]) if inner[1] in known]
        at = piece.end()
        plus = PLUS.match(text, at)
        if not plus:
            break
        at = plus.end()
    return found, at if bare is None else bare


def _name_before(text: bytes, since: int, at: int) -> bytes:
    """The name, quoted or not, that ends at an operator; empty where there is none."""
    head = text[since:at].rstrip(b" \t")
    quote = head[-1:] if head[-1:] in (b'"', b"'") else b""
    head = head[: len(head) - len(quote)]
    body = head.rstrip(NAME_BYTES)
    name = head[len(body) :]
    if quote:
        return name if body.endswith(quote) and name[:1] not in NO_FIRST else b""
    return name.lstrip(NO_FIRST)


def _scored(text: bytes, weight: float, spans: list[Span]) -> set[Span]:
    """The literals that look like secrets, or all where they do when joined."""
    found = {s for s in spans if weight * shape(text[s[0] : s[1]]) >= THRESHOLD}
    if len(spans) > 1 and weight * shape(b"".join(text[a:b] for a, b in spans)) >= THRESHOLD:
        found |= {s for s in spans if s[0] < s[1]}
    return found


def named_literals(text: bytes) -> list[Span]:
    """Byte spans of the literals that reach a sensitive name with a sufficient score."""
    known: dict[bytes, _Constant] = {}
    found: set[Span] = set()
    at = 0
    while op := OPERATOR.search(text, at):
        name, at = _name_before(text, at, op.start()), op.end()
        if not name:
            continue
        value, at = _value(text, BLANKS.match(text, at).end(), known)
        known[name] = value
        if weight := sensitivity(name):
            found |= _scored(text, weight, value.literals())
    for pattern in (TAG, OPTION):
        for m in pattern.finditer(text):
            if weight := sensitivity(m[1]):
                found |= _scored(text, weight, [m.span(2)])
    return sorted(found)


def find(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes of every span, in order."""
    low = text.lower()
    found = []
    if any(s in low for s in ASSIGN_STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(s in low for s in STEMS):
        found += [(a, 3, b) for a, b in named_literals(text)]
    return sorted(found)


def in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points; the text is decoded once at most."""
    if text.isascii() or not found:
        return found
    at, n, of = 0, 0, {}
    for offset in sorted({x for a, _, b in found for x in (a, b)}):
        n += len(text[at:offset].decode("utf-8", "replace"))
        at = offset
        of[offset] = n
    return [(of[a], k, of[b]) for a, k, b in found]


def _rows(texts: pa.Array) -> pa.Array:
    rows = []
    for x in texts:
        text = x.as_buffer().to_pybytes() if x.is_valid else b""
        found = in_code_points(text, find(text))
        said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
        base = ",".join(s for s, f in zip(said, found) if f[1] < 3)
        rows.append((*(sum(f[1] == k for f in found) for k in range(3)), base, ",".join(said)))
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()
    names = ["n_assign", "n_access", "n_hex", "base", "spans"]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names)


def scanned(text: Column) -> Column:
    """Counts of the base kinds, and the spans of the base and of all kinds as text."""

    @F.arrow_udf(RESULT)
    def spans(texts: pa.Array) -> pa.Array:
        return _rows(texts)

    return spans(text)


def mark(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans."""
    found = docs.withColumn("_found", scanned(F.col("text")))
    for name in ("n_assign", "n_access", "n_hex"):
        found = found.withColumn(name, F.col(f"_found.{name}"))
    return found.withColumn("base_sha256", F.sha2("_found.base", 256)).withColumn("spans", F.col("_found.spans")).drop("_found")
