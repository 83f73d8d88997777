"""Periodic runs: stretches of words that repeat with a fixed period, found by seeds on diagonals.

A run of period q has ``max(LEAST_WORDS, LEAST_POWER * q)`` words or more, so it agrees with itself moved by q
over ``guaranteed(q)`` words at least. Seeds are k-grams with q <= k <= guaranteed(q): such a gram lies in the
run, and its next occurrence in the text is exactly q words on, since a primitive word differs from all its
rotations. So of a gram's occurrences only neighbours are paired, never all, and three times longer grams serve
three times longer periods: ``k = 5, 15, 45, …``. A pair is a point on the diagonal of its lag. It is extended to
both sides by comparing words; a table by lag of how far the last extension came passes over the pairs inside.

Grams are ranked exactly, by sorting ranks of shorter ones; longer grams are ranked only where all of their
parts occur again. A batch of texts is ranked at once, with a word of its own between every two texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photofold.llm.common import pieces, small_batches
from photofold.llm.words import lean

LEAST_WORDS = 6
LEAST_POWER = 4

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def guaranteed(period: int) -> int:
    """How many words a run of this period shares with itself moved by the period."""
    return max(LEAST_WORDS, LEAST_POWER * period) - period


def gram_sizes(longest: int) -> list[int]:
    """Gram sizes that serve all periods of runs of up to ``longest`` words."""
    sizes, period = [], 1
    while max(LEAST_WORDS, LEAST_POWER * period) <= longest:
        most = guaranteed(period)
        sizes.append(most // sizes[-1] * sizes[-1] if sizes else most)  # a multiple, so that shorter grams make up longer ones
        period = sizes[-1] + 1
    return sizes


def _pair_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    top = int(second.max(initial=0)) + 1
    return np.unique(first * top + second, return_inverse=True)[1]


class _Grams:
    """Ranks of the k-grams that begin at ``at``; of ranks, equal ones stand for equal grams."""

    def __init__(self, words: np.ndarray):
        self.k, self.at, self.rank, self.size = 1, np.arange(len(words)), words, len(words)

    def again(self) -> None:
        """Leave out grams that occur once."""
        seen = np.bincount(self.rank)[self.rank] > 1
        self.at, self.rank = self.at[seen], self.rank[seen]

    def joined(self, other: _Grams) -> _Grams:
        """Grams of this size followed by one of the other size."""
        place = np.full(self.size + 1, -1)
        place[other.at] = other.rank
        behind = place[np.minimum(self.at + self.k, self.size)]
        both = behind >= 0
        out = object.__new__(_Grams)
        out.k, out.size, out.at = self.k + other.k, self.size, self.at[both]
        out.rank = _pair_ranks(self.rank[both], behind[both])
        out.again()
        return out

    def sized(self, k: int) -> _Grams:
        """Grams of ``k`` words put together from these."""
        out, power, left = None, self, k // self.k
        if left * self.k != k:
            raise ValueError("sizes must divide")
        while left:
            if left & 1:
                out = power if out is None else out.joined(power)
            left >>= 1
            power = power.joined(power) if left else power
        return out

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Each occurrence that has a next one within ``k`` words, and the lag to it."""
        order = np.argsort(self.rank, kind="stable")
        at, rank = self.at[order], self.rank[order]
        lag = at[1:] - at[:-1]
        near = (rank[1:] == rank[:-1]) & (lag <= self.k)
        return at[:-1][near], lag[near]


def _agree(words: np.ndarray, left: int, right: int, step: int) -> int:
    """How many words agree from ``left`` and ``right`` on, going up or down."""
    n, size = 0, 16
    while True:
        if step > 0:
            a, b = words[left + n : left + n + size], words[right + n : right + n + size]
            a = a[: len(b)]
        else:
            low = max(0, left - n - size + 1)
            a = words[low : left - n + 1][::-1]
            b = words[right - n - len(a) + 1 : right - n + 1][::-1]
        different = np.flatnonzero(a != b)
        if len(different):
            return n + int(different[0])
        n += len(a)
        if len(a) < size:
            return n
        size *= 4


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period. ``longest`` bounds the words of one text.

    Equal words have equal numbers, from 0 on.
    """
    found = set()
    grams = _Grams(words)
    grams.again()
    for size in gram_sizes(longest):
        grams = grams.sized(size)
        if not len(grams.at):
            break
        at, lag = grams.neighbours()
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        head = np.ones(len(at), bool)  # pairs that follow at once on a diagonal lie in the same extension
        head[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(at[head].tolist(), lag[head].tolist()):
            if i < covered.get(q, 0):
                continue
            start = i - _agree(words, i - 1, i + q - 1, -1) if i else 0
            end = i + size + _agree(words, i + size, i + size + q, 1)
            covered[q] = end
            length = end - start + q
            if length >= max(LEAST_WORDS, LEAST_POWER * q):
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: Sequence[Sequence[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    known: dict[bytes, int] = {}
    flat: list[int] = []
    for words in texts:
        flat.extend([known.setdefault(w, len(known)) for w in words])
        flat.append(-1)
    numbers = np.array(flat, np.int64)
    breaks = np.flatnonzero(numbers < 0)
    numbers[breaks] = np.arange(len(known), len(known) + len(breaks))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    first = np.concatenate([[0], breaks + 1])
    for start, length, period in find_runs(numbers, max(map(len, texts), default=0)):
        text = int(np.searchsorted(breaks, start))
        out[text].append((start - int(first[text]), length, period))
    return out


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length/period; ties by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def detect(docs: DataFrame) -> DataFrame:
    """One row per input row, without a shuffle: ``doc_id``, ``n_words``, ``n_runs``, the strongest run (``start``, ``length``,
    ``period``, ``exponent_milli``), all ``runs`` by start, then period, and ``collapsed``, the text with every run cut down to one period.

    Words are what ASCII white space divides; ``collapsed`` joins them by one space. A text that is null, empty or
    white space has no words and no runs, the strongest run is null and ``collapsed`` empty. Repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result. Whole texts are searched in n log² n steps; one
    text is held by one task.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            rows = []
            for name, words, runs in zip(batch.column(0).to_pylist(), texts, runs_of_texts(texts)):
                start, length, period = strongest(runs) or (None, None, None)
                rows.append({
                    "doc_id": name, "n_words": len(words), "n_runs": len(runs), "start": start, "length": length, "period": period,
                    "exponent_milli": 1000 * length // period if runs else None,
                    "runs": [dict(zip(("start", "length", "period"), r)) for r in runs],
                    "collapsed": b" ".join(collapse(words, runs)).decode(),
                })
            yield pa.RecordBatch.from_pylist(rows, _arrow())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)


def _arrow() -> pa.Schema:
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    numbers = ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")
    return pa.schema([*((n, pa.int64()) for n in numbers), ("runs", pa.list_(one)), ("collapsed", pa.string())])


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of some documents with a tail that repeats: one in ten by the checksum of the id."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with the words of ``repeated_tail`` joined by one space. A null id counts as the text ``None``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            ids = batch.column(0).to_pylist()
            texts = [b" ".join(repeated_tail((t or b"").split(), i)) for i, t in zip(ids, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """The runs and the collapsed text of ``detect`` as checksums."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
