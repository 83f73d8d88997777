"""Rows named by id and text, and cutting byte spans out of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photofold.llm.common import pieces, small_batches, text_tag
from photofold.llm.words import lean


def named_bytes(docs: DataFrame, tag: Column | None = None) -> DataFrame:
    """``doc_id``, ``tag`` (a hash that tells rows with one id apart, by default by their text) and the whole ``text`` as bytes."""
    small_batches(docs.sparkSession)
    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (text_tag(F.col("text")) if tag is None else tag).alias("tag"), whole.cast("binary").alias("text"))


def with_lists(rows: DataFrame, lists: DataFrame, how: str = "left") -> DataFrame:
    """Rows of ``named_bytes`` with the other columns of ``lists``, which has one row for each (doc_id, tag)."""
    on = rows["doc_id"].eqNullSafe(lists["doc_id"]) & (rows["tag"] == lists["tag"])
    return rows.join(lists, on, how).select(rows["*"], *[lists[c] for c in lists.columns if c not in ("doc_id", "tag")])


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal spans, in order; touching spans are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def cut_spans(docs: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """Remove the union of ``spans`` (``doc_id``, ``tag``, ``start``, ``end``) from the texts; runs below ``least`` bytes stay.

    One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs), ``kept`` (bytes) and ``kept_sha256``.
    """
    # Equal rows that share an id, or have none, name the same spans: each is kept once.
    each = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    lists = each.select("doc_id", "tag", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("text", "starts", "ends")]
            removed, runs, kept = [], [], []
            for text, starts, ends in zip(columns[0].to_pylist(), columns[1], columns[2]):
                if not starts.is_valid:
                    removed.append(0), runs.append(0), kept.append(text)
                    continue
                a, b = union_of(starts.values.to_numpy(), ends.values.to_numpy())
                long = b - a >= least
                a, b = a[long].tolist(), b[long].tolist()
                removed.append(sum(b) - sum(a))
                runs.append(len(a))
                kept.append(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array([len(t) for t in columns[0].to_pylist()], pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return with_lists(named_bytes(docs), lists).mapInArrow(
        lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )
