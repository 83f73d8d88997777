"""Secret scan: base patterns, and literals found by lexing assignments.

The lexer reads source code and configuration as (name, literal) pairs: ``name = "literal"``, ``"name":
"literal"``, ``name: literal``, ``NAME := 'a' + 'b'``, ``name => literal``. Constants are carried along within a text, so in
``K = "..."`` followed by ``db_password = K`` the literal is judged by the name ``db_password``. A literal's score
is the sensitivity of the words of its name plus what its characters suggest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from photofold.llm.common import id_and_text, pieces
from photofold.llm.words import lean

# The base patterns, in the order of their kinds, and the least length of what they must find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "named")

#: Sensitivity of a name by its words; single words and pairs of words.
SENSITIVE = {
    "password": 4, "passwd": 4, "passphrase": 4, "pwd": 3, "secret": 4, "token": 3, "apikey": 4, "credential": 3,
    "credentials": 3, "bearer": 3, "auth": 2, "api key": 4, "access key": 4, "private key": 4, "secret key": 4,
    "signing key": 3, "encryption key": 3, "account key": 3, "client secret": 4, "key": 1, "salt": 1,
}
#: Words that make a name that of something else.
HARMLESS = {
    "count", "max", "min", "length", "size", "limit", "file", "path", "url", "name", "type", "field", "hint", "label",
    "policy", "expires", "ttl", "index", "id",
}
PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|your[_-]|dummy|^(null|none|true|false|todo)$|^[x*.<{$\-]+|(.)\2{5}")
THRESHOLD = 6
LEAST_LITERAL = 8
LONGEST_NAME = 128

_NAME = re.compile(
    r"(?<![\w.-])([A-Za-z_][\w.-]{0,%d})[\"']?[ \t]*(?:\[[ \t]*[\"'](\w{1,128})[\"'][ \t]*\])?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*"
    % (LONGEST_NAME - 1)
)
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|([^\s,;\"'(){}\[\]<>+]+)")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def sensitivity(name: str) -> int:
    words = [w.lower() for w in _WORD.findall(name)]
    found = [SENSITIVE.get(w, 0) for w in words] + [SENSITIVE.get(f"{a} {b}", 0) for a, b in zip(words, words[1:])]
    return max(found, default=0) - 3 * any(w in HARMLESS for w in words[-1:])


def strength(value: str) -> int:
    """What the characters of a literal suggest: entropy and kinds of characters, less for prose and stand-ins."""
    if len(value) < LEAST_LITERAL or PLACEHOLDER.search(value):
        return -9
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value))))
    return (entropy >= 2.5) + (entropy >= 3.5) + (kinds >= 2) + bool(re.search("[0-9]", value)) - 4 * bool(re.search(r"\s", value))


class _Value:
    """What an assignment gives its name: literals, and the values of constants among them, which are shared and not copied."""

    __slots__ = ("parts",)

    def __init__(self, parts: list[tuple[int, int, str] | _Value]):
        self.parts = parts

    def literals(self) -> list[tuple[int, int, str]]:
        """Every literal that goes into the value, once, where it is first met."""
        found, seen, todo = [], set(), [self]
        while todo:
            one = todo.pop()
            if not isinstance(one, _Value):
                found.append(one)
            elif id(one) not in seen:
                seen.add(id(one))
                todo.extend(reversed(one.parts))
        return list(dict.fromkeys(found))


def named_literals(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, name, score) of the literals that reach ``THRESHOLD``; a literal once, by its best name.

    A constant used several times in one value counts once in it.
    """
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, _Value] = {}
    found: dict[tuple[int, int], tuple[str, int]] = {}
    for m in _NAME.finditer(text):
        name, at, parts = m[2] or m[1], m.end(), []
        while literal := _LITERAL.match(text, at):
            kind = literal.lastindex
            value = literal[kind]
            parts.append(constants[value] if kind == 3 and value in constants else (literal.start(kind), literal.end(kind), value))
            more = _PLUS.match(text, literal.end())
            if not more:
                break
            at = more.end()
        if not parts:
            continue
        whole = _Value(parts)
        if _IDENTIFIER.fullmatch(name):
            constants[name] = whole
        level = sensitivity(name)
        if level <= 0:
            continue
        parts = whole.literals()
        score = level + strength("".join(v for _, _, v in parts))
        if score >= THRESHOLD:
            for start, end, value in parts:
                if value and found.get((start, end), ("", 0))[1] < score:
                    found[start, end] = (name, score)
    return [(s, e, name, score) for (s, e), (name, score) in sorted(found.items())]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches that are long enough."""
    out, low = [], text.lower()
    if any(word in low for word in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_named``, ``base`` and ``spans`` (as
    ``kind:start:end``, by start, then kind; code points, end exclusive) and ``named``, the lexed literals with
    the name that gives them away.

    The text is scanned whole, in place, without a shuffle. A null text is empty and has no spans. A name
    longer than ``LONGEST_NAME`` characters is not lexed as one. Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string()),
             ("named", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.int64())])))]
        )
        for batch in pieces(batches, 1 << 20):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, named = base_spans(text), named_literals(text)
                count = Counter(kind for _, kind, _ in base)
                every = sorted(base + [(start, 3, end) for start, end, _, _ in named])
                rows.append({
                    "doc_id": doc, "n_assign": count[0], "n_access": count[1], "n_hex": count[2], "n_named": len(named),
                    "base": _listed(base), "spans": _listed(every),
                    "named": [dict(zip(("start", "end", "name", "score"), x)) for x in named],
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    rows = id_and_text(docs)
    return rows.withColumn("doc_id", rows.doc_id.cast("long")).mapInArrow(
        lean(run),
        "doc_id long, n_assign long, n_access long, n_hex long, n_named long, base string, spans string, "
        "named array<struct<start:long,end:long,name:string,score:long>>",
    )
