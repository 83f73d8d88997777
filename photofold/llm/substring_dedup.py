"""Substring dedup by content-defined chunks.

A gear rolling hash over the last ``GEAR`` bytes is taken at every byte; a byte ends a chunk where its hash is the
largest within ``REACH`` bytes on both sides. Where chunks end therefore depends on some eighty bytes around it
only, and an insertion shifts no chunk beyond them. Chunks are deduplicated by digest; the first in order of
document id and place stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photofold.llm.common import pieces
from photofold.llm.spans import cut_spans, named_bytes
from photofold.llm.words import lean, mix
from photofold.session import cut_lineage

GEAR = 24
REACH = 28
LONGEST = 4096
LEAST_RUN = 64


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of it and the ``GEAR - 1`` bytes before, by doubling the window."""
    table = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    total, width, out, done = table[data], 1, None, 0
    while True:
        if GEAR & width:
            out = total if out is None else total + (_shifted(out, width) << np.uint32(width))
            done += width
        if done == GEAR:
            break
        total = total + (_shifted(total, width) << np.uint32(width))
        width *= 2
    return out << np.uint32(32 - GEAR) if GEAR < 32 else out


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[by:] = x[:-by]
    return out


def _largest(x: np.ndarray, width: int) -> np.ndarray:
    """Largest of x[i : i + width] for each i; beyond the end nothing counts."""
    n = len(x)
    padded = np.zeros(-(-(n + width) // width) * width, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    forth = np.maximum.accumulate(rows, axis=1).ravel()
    back = np.maximum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(back[:n], forth[width - 1 : n + width - 1])


def chunks(texts: Sequence[bytes]) -> list[np.ndarray]:
    """Ends of the chunks of each text; the last is its length, and an empty text has none."""
    gap = bytes(GEAR + 2 * REACH)
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    h = gear_hashes(data)
    n = len(h)
    after = np.zeros(n, np.uint32)
    after[:-1] = _largest(h, REACH)[1:]
    before = np.zeros(n, np.uint32)
    before[REACH:] = _largest(h, REACH)[: n - REACH]
    cut = np.flatnonzero((h > before) & (h >= after)) + 1
    out, start = [], len(gap)
    for t in texts:
        x, y = np.searchsorted(cut, [start + 1, start + len(t)])
        ends = np.append(cut[x:y] - start, len(t)) if t else cut[:0]
        sizes = np.diff(ends, prepend=0)
        if len(sizes) and sizes.max() > LONGEST:
            ends = np.concatenate([np.append(np.arange(e - s + LONGEST, e, LONGEST), e) for e, s in zip(ends, sizes)])
        out.append(ends)
        start += len(t) + len(gap)
    return out


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tag``, ``start``, ``end`` and ``digest`` of every chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 19):
            texts = batch.column(2).to_pylist()
            ends = chunks(texts)
            counts = [len(e) for e in ends]
            if not sum(counts):
                continue
            starts = [np.concatenate([[0], e[:-1]]) for e in ends if len(e)]
            digests = [
                hashlib.blake2b(t[a:b], digest_size=16).digest()
                for t, e in zip(texts, ends)
                for a, b in zip([0, *e[:-1].tolist()], e.tolist())
            ]
            row = pa.array(np.repeat(np.arange(len(texts)), counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(starts), pa.int64()),
                 pa.array(np.concatenate(ends), pa.int64()), pa.array(digests, pa.binary())],
                ["doc_id", "tag", "start", "end", "digest"],
            )

    return named_bytes(docs).mapInArrow(lean(run), "doc_id long, tag long, start long, end long, digest binary")


def dedup_substrings(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """Remove chunks that stand earlier, where ``least_run`` bytes or more go in a row.

    One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes, which may break a character) and
    ``kept_sha256``. Earlier means a smaller id (null is the smallest) or an earlier place in the same document; of rows that
    share an id and the place, all keep the chunk. A null or empty text has no chunks. Other columns are ignored;
    an empty table gives an empty result.

    A digest is counted before the shuffle, and one that very many documents hold is an ordinary row of the table of repeated
    digests. That table is stored, so that Spark can split the other side of its join where it is skewed.
    """
    rows = chunk_rows(docs)
    counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    first = cut_lineage(counted.filter("n > 1").select("digest", "first"))
    again = rows.join(first, "digest").filter(~F.struct("doc_id", "start").eqNullSafe(F.col("first")))
    return cut_spans(docs, again.select("doc_id", "tag", "start", "end"), least_run)
