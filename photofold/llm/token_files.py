"""Token ids in grammar-compressed blocks with random access.

Documents are range-partitioned by id; every task encodes its documents in that order, cuts the
ids into blocks of some 131,072 (a document never spans two blocks) and compresses each block by
Re-Pair: frequent pairs of symbols are replaced by new symbols, again and again. A block stores the
rules, the length that every rule expands to and the remaining sequence, so that a range of ids is
decoded from the symbols that overlap it only. Blocks are rows of a Parquet table, which Spark
writes and reads wherever the data lies; a lost task writes its blocks again.

One round replaces many pairs at once: every pair that is frequent enough becomes a rule, and where
occurrences overlap the more frequent pair wins. Rounds end when they no longer pay.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photofold.llm.common import id_and_text, pieces, task_count
from photofold.llm.words import Bytes, lean, worker_memory
from photofold.session import run_folder

BLOCK_IDS = 1 << 17
MIN_COUNT = 6
CACHED_WORDS = 300_000

BLOCK_SCHEMA = (
    "part int, block int, start_in_part long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
    "base int, rules binary, rule_lengths binary, width int, sequence binary"
)

# Texts of these characters alone are lower-cased and cut into letters, digits and other marks just as the
# tokenizer would: no apostrophe, no special token, nothing that another Unicode version may class otherwise.
_OTHER = re.compile("[^\n\r\t !-&(-;=-~ªµºÀ-ÖØ-öø-ÿ¡¿«»·–—’“”…•]")
_GAP = re.compile("[ \n\r\t]+")
_SPACE, _LETTER, _MARK, _DIGIT = range(4)
_TOGETHER = 64


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of every byte of lower-case UTF-8 made of the characters above."""
    kind = np.full(256, _MARK, np.uint8)
    kind[[9, 10, 13, 32]] = _SPACE
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[ord("a") : ord("z") + 1] = _LETTER
    out = kind[data]
    lead = np.flatnonzero((data == 0xC3) | (data == 0xC2))
    low, second = data[lead] == 0xC2, data[lead + 1]
    letter = np.where(low, np.isin(second, [0xAA, 0xB5, 0xBA]), (second != 0x97) & (second != 0xB7))
    out[lead[letter]] = out[lead[letter] + 1] = _LETTER
    return out


class WordEncoder:
    """Ids of whole texts by the given tokenizer; a word that comes again is not encoded again.

    White space always ends a word of this kind of tokenizer, so a text's ids are those of its words in
    turn. At most ``CACHED_WORDS`` words are kept from one batch to the next.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        """The encoder of this Python worker, which serves many tasks."""
        encoders = worker_memory().setdefault("encoders", {})
        if path not in encoders:
            encoders[path] = cls(path)
        return encoders[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        plain = [not _OTHER.search(t) for t in texts]
        fast = iter(self._plain([t for t, p in zip(texts, plain) if p]))
        return [next(fast) if p else self._any(t) for t, p in zip(texts, plain)]

    def _any(self, text: str) -> bytes:
        """Cut at white space only; right for every text."""
        words = _GAP.split(text)
        new = list(set(words).difference(self.known))
        for word, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[word] = np.array(e.ids, dtype="<u4").tobytes()
        return b"".join(map(self.known.__getitem__, words))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Cut into words as arrays; each batch looks up its distinct words only."""
        b = Bytes([t.lower().encode() for t in texts])
        if not len(b.data):
            return [b""] * len(texts)
        kind = _classes(b.data)
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[b.start[b.start < b.end]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(kind))
        word = kind[start] != _SPACE
        start, end = start[word], end[word]
        if not len(start):
            return [b""] * len(texts)
        keys = b.hashes(start, end)
        bits = max(10, int(len(keys)).bit_length() + 1)
        slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
        owner = np.zeros(1 << bits, np.int64)
        owner[slot] = np.arange(len(keys))
        owner = owner[slot]  # a place where the same word stands; words that share a slot stand for themselves
        owner = np.where(keys[owner] == keys, owner, np.arange(len(keys)))
        chosen = np.flatnonzero(np.bincount(owner, minlength=len(keys)))
        index = np.zeros(len(keys), np.int64)
        index[chosen] = np.arange(len(chosen))
        index = index[owner]
        raw = b.data.tobytes()
        ids = self._look_up([raw[x:y] for x, y in zip(start[chosen].tolist(), end[chosen].tolist())])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), "<u4")
        each = size[index]
        ends = np.cumsum(each)
        out = flat[np.repeat(first[index] - (ends - each), each) + np.arange(int(ends[-1]))].tobytes()
        edges = np.concatenate([[0], ends])[np.searchsorted(start, np.append(b.start, len(kind)))] * 4
        return [out[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        new = list(set(words).difference(known))
        groups = [new[i : i + _TOGETHER] for i in range(0, len(new), _TOGETHER)]
        texts = [b" ".join(g).decode() for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != len(group):
                raise ValueError("not a tokenizer whose words all end in </w>")
            raw, begin = ids.tobytes(), 0
            for word, end in zip(group, ends.tolist()):
                known[word] = raw[begin:end]
                begin = end
        return list(map(known.__getitem__, words))


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: ``(base, rules, lengths, sequence)``.

    ``rules[k]`` is the pair that symbol ``base + k`` stands for, ``lengths[k]`` the number of ids it
    expands to. Rules refer to earlier rules only.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    seq, next_symbol = ids.astype(np.int64), base
    rules, lengths = [np.empty((0, 2), np.int64)], np.ones(0, np.int64)
    bits = max(10, int(len(seq)).bit_length())
    while len(seq) > 1:
        pairs = (seq[:-1] << 32) | seq[1:]
        slot = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        owner = np.zeros(1 << bits, np.int64)
        owner[slot] = pairs  # of pairs that meet in a slot one is counted now, others in later rounds
        counted = owner[slot] == pairs
        count = np.bincount(slot[counted], minlength=1 << bits)
        gain = np.where(counted, count[slot], 0)
        gain[gain < min_count] = 0
        before, after = np.concatenate([[0], gain[:-1]]), np.concatenate([gain[1:], [0]])
        at = np.flatnonzero((gain > before) & (gain >= after))  # no two of these overlap
        used = np.bincount(slot[at], minlength=1 << bits)
        at = at[used[slot[at]] >= min_count]
        if len(at) * 50 < len(seq):
            break
        slots = np.flatnonzero(np.bincount(slot[at], minlength=1 << bits))
        new = np.stack([owner[slots] >> 32, owner[slots] & 0xFFFFFFFF], 1)
        symbol = np.zeros(1 << bits, np.int64)
        symbol[slots] = np.arange(next_symbol, next_symbol + len(slots))
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = symbol[slot[at]]
        seq = seq[keep]
        rules.append(new)
        lengths = np.concatenate([lengths, _length_of(new[:, 0], base, lengths) + _length_of(new[:, 1], base, lengths)])
        next_symbol += len(slots)
    return base, np.concatenate(rules), lengths, seq


def _length_of(symbols: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    made = symbols >= base
    out[made] = lengths[symbols[made] - base]
    return out


def expand(sequence: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for: every rule is expanded once, then copied to its places."""
    if not len(rules) or not len(sequence):
        return sequence
    flat = np.arange(base, base + len(rules))
    while (made := flat >= base).any():
        width = np.where(made, 2, 1)
        start = np.cumsum(width) - width
        longer = np.empty(int(width.sum()), np.int64)
        longer[start] = np.where(made, rules[np.where(made, flat - base, 0), 0], flat)
        longer[start[made] + 1] = rules[flat[made] - base, 1]
        flat = longer
    size = _length_of(sequence, base, lengths)
    ends = np.cumsum(size)
    made = sequence >= base
    first = np.cumsum(lengths) - lengths
    out = np.repeat(np.where(made, 0, sequence), size)
    shift = np.repeat(first[sequence[made] - base] - (ends - size)[made], size[made])
    inside = np.flatnonzero(np.repeat(made, size))
    out[inside] = flat[shift + inside]
    return out


def decode_range(block, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (exclusive) of a block, expanding only the symbols that overlap them."""
    base, rules, lengths, seq = unpack(block)
    ends = np.cumsum(_length_of(seq, base, lengths))
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    before = int(ends[first - 1]) if first else 0
    return expand(seq[first : last + 1], base, rules, lengths)[start - before : stop - before]


def pack(base: int, rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray) -> dict:
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {
        "base": base,
        "rules": rules.astype("<u4").tobytes(),
        "rule_lengths": lengths.astype("<u4").tobytes(),
        "width": width,
        "sequence": seq.astype(f"<u{width}").tobytes(),
    }


def unpack(block) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    return (
        block["base"],
        np.frombuffer(block["rules"], "<u4").astype(np.int64).reshape(-1, 2),
        np.frombuffer(block["rule_lengths"], "<u4").astype(np.int64),
        np.frombuffer(block["sequence"], f"<u{block['width']}").astype(np.int64),
    )


def _arrow_schema(ddl_names: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (field.split() for field in ddl_names.split(", "))])


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every whole text, append ``end_id`` to each document and write the blocks to ``path``.

    Documents are written in ascending order of ``doc_id``, null first; rows with the same id by their
    text. A null text is empty, so only the end id is written. Other columns are ignored; an empty table
    writes no blocks. A task holds one block and one batch of texts, or one document that is longer.
    """
    rows = id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = (
        rows.repartitionByRange(task_count(docs), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .drop("tie")
    )
    schema, end = _arrow_schema(BLOCK_SCHEMA), np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of_worker(tokenizer), TaskContext.get().partitionId()
        ids, names, sizes, number, written = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal number, written
            n = sum(sizes)
            row = {
                "part": part, "block": number, "start_in_part": written, "n_ids": n,
                "doc_ids": list(names), "doc_lengths": list(sizes),
                **pack(*compress(np.frombuffer(b"".join(ids), "<u4"))),
            }
            number, written = number + 1, written + n
            for kept in (ids, names, sizes):
                kept.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        total = 0
        for batch in pieces(batches, 1_500_000):
            for name, own in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids.append(own + end)
                names.append(name)
                sizes.append(len(own) // 4 + 1)
                total += sizes[-1]
                if total >= block_ids:
                    total = 0
                    yield block()
        if names:
            yield block()

    ordered.mapInArrow(lean(blocks, ["encoders"]), BLOCK_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids before it in the whole file), ``n_tokens`` and
    ``ids`` (binary, little-endian unsigned 32-bit integers)."""
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # one row for each task that wrote
        stored.groupBy("part")
        .agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    )

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                base, rules, lengths, seq = unpack(row)
                ids = expand(seq, base, rules, lengths).astype("<u4")
                n = np.array(row["doc_lengths"], np.int64)
                local = np.cumsum(n) - n
                starts = row["part_start"] + row["start_in_part"] + local
                raw = [ids[a : a + b].tobytes() for a, b in zip(local, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(n), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return stored.join(F.broadcast(starts), "part").mapInArrow(
        lean(documents), "doc_id long, start long, n_tokens long, ids binary"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write to a new folder below the session's shared one and read back."""
    path = run_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)

