"""Words of many texts at once, as numpy arrays.

A word is a run of bytes other than ASCII white space, so words of UTF-8 text need no decoding. Hashes of
byte ranges come from prefix sums of a polynomial in 64-bit arithmetic and a final mix.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def worker_memory() -> dict:
    """What this Python worker keeps from one task to the next; never shipped with code."""
    return sys.modules.setdefault("_photofold_worker", types.ModuleType("_photofold_worker")).__dict__


def lean(run: Callable[[Iterable], Iterator], keep: Sequence[str] = ()) -> Callable[[Iterable], Iterator]:
    """The same function of batches, leaving its Python worker small: workers serve the tasks of all stages, one after the other.

    What other operators left in ``worker_memory`` is dropped at the start, all but ``keep`` at the end, and freed memory goes
    back to the system.
    """

    def wrapped(batches: Iterable) -> Iterator:
        forget(keep)
        try:
            yield from run(batches)
        finally:
            forget(keep)

    return wrapped


def forget(keep: Sequence[str] = ()) -> None:
    import ctypes

    import pyarrow as pa

    memory = worker_memory()
    for name in [k for k in memory if not k.startswith("__") and k not in keep]:
        del memory[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    known = worker_memory().get("powers")
    if known is None or len(known[0]) < n:
        size = 1 << max(16, n.bit_length())

        def powers(base: int) -> np.ndarray:
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        known = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
        if size <= 1 << 21:
            worker_memory()["powers"] = known
    return known


class Bytes:
    """Texts laid end to end: ``data``, the ``start`` and ``end`` of each text, and hashes of ranges."""

    def __init__(self, texts: Sequence[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self._sums = None

    def _prepare(self) -> None:
        if self._sums is None:
            n = len(self.data)
            self._power, self._inverse = _powers(n + 1)
            values = mix(np.arange(1, 257, dtype=np.uint64))[self.data]
            values *= self._power[:n]
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values, out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each range of bytes; equal bytes have equal hashes."""
        self._prepare()
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def every(self, size: int) -> np.ndarray:
        """The hashes of all ranges of ``size`` bytes, also those that cross texts."""
        self._prepare()
        raw = self._sums[size:] - self._sums[:-size]
        raw *= self._inverse[: len(raw)]
        raw += np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        return mix(raw)


class Words:
    """``start`` and ``end`` of every word and the text ``doc`` it belongs to, in order."""

    def __init__(self, texts: Sequence[bytes]):
        self.bytes = b = Bytes(texts)
        data = b.data
        space = (data == 32) | ((data >= 9) & (data <= 13))
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        last = inside.copy()
        last[:-1] &= space[1:]
        real = b.start < b.end  # of these, a text's first byte starts a word and its last byte ends one
        first[b.start[real]] |= inside[b.start[real]]
        last[b.end[real] - 1] |= inside[b.end[real] - 1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, b.start)  # of each text its first word
        self.count = np.searchsorted(self.start, b.end) - self.first
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        return self.bytes.hashes(self.start, self.end)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which ``size`` words of one text begin, and the hash of each window."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(total[at])


def per_text(flags_at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    edges = np.searchsorted(flags_at, ends)
    return np.diff(edges, prepend=0)


def repeated(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Flags of the entries whose (key, group) occurs more than once."""
    flags = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return flags
    order = np.lexsort((keys, groups)) if len(keys) < 1 << 12 else np.argsort(keys ^ mix(groups.astype(np.uint64)))
    k, g = keys[order], groups[order]
    equal = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    flags[order[1:][equal]] = True
    flags[order[:-1][equal]] = True
    return flags


def covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Flags of the positions below ``size`` that some [start, start + length) covers."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0
