"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration text.

Base spans come from three patterns. On top, each ``name = literal`` of the text is
lexed into a pair: the operator (``=``, ``:``, ``:=``, ``=>``) is found first, then the
whole name to its left, whatever its length, and the literal to its right: quoted (also
triple or by backticks), joined by ``+``, a known name, or bare up to the next blank, ``&`` or
operator. A type between name and ``=`` is passed over (``token: str = "…"``). Names bound to
literals are propagated, so ``k = "…"; password = k`` scores the literal that ``k`` holds. A
pair is scored by what its name says and what its literal looks like; literals at
``THRESHOLD`` or above add a span of kind ``literal``.

What is kept of a literal is its span and the shares of its characters, which cover all of
it and add up when literals are joined. So joining a name with itself again and again
costs no more than any other line, and time and memory are linear in the text.

Every text is scanned whole, one row at a time inside Arrow batches; there is no
shuffle, and a lost task is simply run again.

Defined cases: a null or empty text has no spans (the digest is that of the empty
string). Repeated rows each get their result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Order of kinds in listings.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs below 32 characters fail anyway; asking for 32 at once finds the same runs.
HEX = re.compile(r"[0-9a-f]{32,}")

OPERATOR = re.compile(r":=|=>|[:=]")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
#: A type between a name with a colon and the sign of equality.
TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.]*(?:[ \t]*[\[<][\w.,| \t]*[\]>])?[ \t]*(?==(?![=>]))", re.A)
STRING = re.compile(
    r'''"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*)"|\'(?P<d>(?:[^\'\\\n]|\\.)*)\'|`(?P<e>(?:[^`\\]|\\.)*)`''', re.S)
BARE = re.compile(r"[^\s\"'`,;&(){}\[\]<>=:]+=*")
PLUS = re.compile(r"[ \t]*\+[ \t]*")
NAME = re.compile(r"[A-Za-z_][\w.]*", re.A)
#: Parts of names that hold secrets, and how strongly they say so.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "apikey": 3, "privatekey": 3, "accesskey": 3,
    "secretkey": 3, "credential": 3, "credentials": 3, "token": 3, "bearer": 2, "auth": 2, "signature": 1, "salt": 1,
    "key": 1, "pass": 1,
}
THRESHOLD = 5


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the three base patterns, leftmost and not overlapping within a kind."""
    spans = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> int:
    """How much a name speaks for a secret, by its parts (``apiKey``, ``db.password``, ``AUTH_TOKEN`` …)."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return max([SENSITIVE.get(p, 0) for p in joined.union(parts)], default=0)


class Literal(NamedTuple):
    """Span of a literal, its length, the share of each of its characters, and whether it only stands for a value."""

    start: int
    end: int
    length: float
    shares: dict[str, float]
    placeholder: bool

    @classmethod
    def of(cls, text: str, start: int, end: int) -> Literal:
        value, n = text[start:end], end - start
        return cls(start, end, n, {c: k / n for c, k in Counter(value).items()},
                   bool(re.fullmatch(r"\$\{.*|%\w+%|<.*>|\*+|x+", value, re.I | re.S)))

    def joined(self, other: Literal, end: int) -> Literal:
        length = self.length + other.length
        if not length:
            return self._replace(end=end)
        shares = {c: p * self.length / length for c, p in self.shares.items()}
        for c, p in other.shares.items():
            shares[c] = shares.get(c, 0.0) + p * other.length / length
        # beyond any real length only the shares matter
        return Literal(self.start, end, min(length, 1e18), shares, self.placeholder and other.placeholder)


def literal_score(literal: Literal) -> int:
    """How much a literal looks like a secret: long enough, no spaces, mixed classes, high entropy."""
    if literal.length < 8 or literal.placeholder or any(c.isspace() for c in literal.shares):
        return 0
    classes = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdecimal() else "_" if not re.match(r"\w", c) else ""
                   for c in literal.shares} - {""})
    entropy = -sum(p * math.log2(p) for p in literal.shares.values() if p > 0)
    digits = any(c.isdecimal() for c in literal.shares)
    return 1 + (classes >= 2) + (entropy >= 3) + (digits and entropy >= 2.5)


def _literal_at(text: str, at: int, known: dict[str, Literal]) -> Literal | None:
    """The literal that starts at ``at`` or behind blanks; joined strings give one."""
    while at < len(text) and text[at] in " \t":
        at += 1
    found: Literal | None = None
    while True:
        if m := STRING.match(text, at):
            part, end = Literal.of(text, *m.span(m.lastgroup)), m.end(m.lastgroup)
        elif (m := NAME.match(text, at)) and m[0] in known:
            part, end = known[m[0]], m.end()
        elif found is None and (m := BARE.match(text, at)):
            return Literal.of(text, m.start(), m.start() + len(m[0].rstrip(".")))
        else:
            return found if found and found.length else None
        # a single known name keeps the span of the literal it holds
        found = part if found is None else found.joined(part, max(found.end, end))
        step = PLUS.match(text, m.end())
        if not step:
            return found if found.length else None
        at = step.end()


def _name_before(text: str, end: int) -> str:
    """The whole name that ends at ``end`` but for blanks, a quote and a bracket."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] == "]":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and text[start - 1] in NAME_CHARS:
        start -= 1
    while start < end and not (text[start].isalpha() or text[start] == "_"):
        start += 1
    return text[start:end]


def assignments(text: str) -> Iterator[tuple[str, Literal]]:
    """``(name, literal)`` of each pair; known names stand for the literal they hold."""
    known: dict[str, Literal] = {}
    typed: tuple[int, str] = (-1, "")
    for operator in OPERATOR.finditer(text):
        if text.startswith("=", operator.end()):
            continue
        name = typed[1] if operator.start() == typed[0] else _name_before(text, operator.start())
        if not name:
            continue
        if operator[0] == ":" and (kind := TYPE.match(text, operator.end())):
            typed = (kind.end(), name)
            continue
        if found := _literal_at(text, operator.end(), known):
            known[name] = found
            yield name, found


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans; each in order of start, then kind, then end."""
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order)
    extra = {(literal.start, "literal", literal.end) for name, literal in assignments(text)
             if (n := name_score(name)) and (v := literal_score(literal)) and n + v >= THRESHOLD}
    return base, sorted([*base, *extra], key=order)


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``; spans count code points, ends exclusive."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [scan(t.as_py() or "") for t in batch.column(1)]
            counts = [Counter(kind for _, kind, _ in base) for base, _ in rows]
            yield pa.record_batch([
                batch.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3]],
                pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                pa.array([listed(spans) for _, spans in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
