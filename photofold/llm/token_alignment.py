"""Alignment of the tokens that two tokenizers make of one text.

Both tokenizers see the text with a space before it, and tokens are spans of its UTF-8 bytes. ``merge_asof`` finds for the start of
each token the token of the other side that covers it; both directions together are all overlapping pairs. Where the two of a pair
end together, both sides are cut: what lies between two cuts is a group, and every A token of a group is linked to every B token.

Neither tokenizer joins bytes across a single space between two other characters, so a text is cut there first. Such a piece is
encoded and aligned once for each block of documents, however many of them hold it, and frequent ones once for all blocks of a
task. The pieces to align are laid end to end, so that one byte offset places a token of any of them for the merges; ids are spelled
out, as bytes or as digits, by taking them from an Arrow table of the vocabulary.

How many documents hold a pair of ids linked is counted per block, summed over blocks, and looked up for the pairs of each block.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photofold.llm.common import id_and_text, pieces
from photofold.llm.words import lean
from photofold.session import cut_lineage

#: Of text in one block: more than an Arrow batch has, unless it is a single long row.
BLOCK_BYTES = 6 << 20
KNOWN_PIECES = 120_000
ALIGNED_AT_ONCE = 1 << 14
LINKED_AT_ONCE = 1 << 16
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: As ``\s`` has them in Python, for Arrow's expressions.
_SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts of which not every space is a cut, and empty ones.
_ODD = rf"\A(?: |\z)|{_SPACE}(?:{_SPACE}|\z)"
#: Texts that begin with a single space and end otherwise.
_INNER = rf"\A [^{_SPACE[1:]}(?s:.*[^{_SPACE[1:]})?\z"
_TOGETHER = 128
#: A group with more links than this is counted by distinct ids, so that it is never written out.
LONG_GROUP = 1 << 12


def _byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Runs:
    """Byte strings in one buffer, as an Arrow array; ``sizes`` are their lengths."""

    def __init__(self, values: pa.LargeBinaryArray):
        self.values = values

    @classmethod
    def of(cls, values: Sequence[bytes]) -> Runs:
        return cls(pa.array(values, pa.large_binary()))

    @classmethod
    def cut(cls, data: pa.Buffer, edges: np.ndarray) -> Runs:
        """The strings between the edges, of which there is one more than strings."""
        return cls(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), data]))

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        return pc.binary_length(self.values).to_numpy()

    def laid(self, places: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
        """The strings at the places end to end, and the edges between them."""
        edges = np.concatenate([[0], np.cumsum(self.sizes[places])])
        if not edges[-1]:
            return pa.py_buffer(b""), edges
        taken = self.values.take(pa.array(places))
        begin = int(np.frombuffer(taken.buffers()[1], np.int64)[taken.offset])
        return taken.buffers()[2].slice(begin, int(edges[-1])), edges

    def take(self, places: np.ndarray) -> Runs:
        return Runs.cut(*self.laid(places))


class ByteLevel:
    """A byte-level tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_characters()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            known = all(c in byte_of for c in token)
            self.bytes[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.spelled = Runs.of(self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the space put before them."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentence-piece model that puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        if any(" " in b.decode("utf-8", "replace").lstrip(" ") for b in self.bytes):
            raise ValueError("a piece goes across a space: texts can't be cut there")
        self.spelled = Runs.of(self.bytes)

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


@dataclass
class Texts:
    """Texts to encode, their sizes in bytes, and which of them begin with a single space and end otherwise."""

    texts: list[str]

    def __post_init__(self) -> None:
        texts = pa.array(self.texts, pa.large_string())
        self.sizes = pc.binary_length(texts).to_numpy()
        self.plain = pc.match_substring_regex(texts, _INNER).to_numpy(zero_copy_only=False)


def encode_pieces(tokenizer: ByteLevel | Pieces, given: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts end to end, the number of ids of each, and whether their bytes are those of the text (else it has none).

    Plain texts are encoded many at once; the cuts between them are found by bytes.
    """
    texts, table, sizes = given.texts, tokenizer.bytes, tokenizer.spelled.sizes
    count, good = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
    many = np.flatnonzero(given.plain)
    groups = [many[i : i + _TOGETHER] for i in range(0, len(many), _TOGETHER)]
    joined = ["".join([texts[k] for k in g.tolist()]) for g in groups]
    encoded = tokenizer.encode(joined)
    flat = _chained(encoded)
    if not _gives_back(tokenizer, joined, encoded, flat):
        right = [b"".join([table[i] for i in ids]) == text.encode() for text, ids in zip(joined, encoded)]
        many = np.concatenate([np.empty(0, np.int64), *itertools.compress(groups, right)])
        flat = _chained(itertools.compress(encoded, right))
    ends, wanted = np.cumsum(sizes[flat]), np.cumsum(given.sizes[many])
    cut = np.searchsorted(ends, wanted)
    if not np.array_equal(ends[cut], wanted):
        raise ValueError("a token goes across a space: texts can't be cut there")
    count[many] = np.diff(cut + 1, prepend=0)
    if len(many) == len(texts):
        return flat, count, good
    left = np.ones(len(texts), bool)
    left[many] = False
    rest = np.flatnonzero(left)
    single = [texts[k] for k in rest.tolist()]
    alone = []
    for k, text, ids in zip(rest.tolist(), single, tokenizer.encode(single)):
        good[k] = b"".join([table[i] for i in ids]) == text.encode()
        if good[k]:
            count[k] = len(ids)
            alone += ids
    order = np.concatenate([many, rest])
    laid = np.concatenate([flat, np.array(alone, np.int64)])
    first = np.zeros(len(texts), np.int64)
    first[order] = np.cumsum(count[order]) - count[order]
    return laid[_ranges(first, count)], count, good


def _chained(lists: Iterable[list[int]]) -> np.ndarray:
    return np.array(list(itertools.chain.from_iterable(lists)), np.int64)


def _gives_back(tokenizer: ByteLevel | Pieces, texts: list[str], encoded: list[list[int]], flat: np.ndarray) -> bool:
    """Whether the ids of every text have its bytes; ``flat`` has them end to end."""
    written = [t.encode() for t in texts]
    data, edges = tokenizer.spelled.laid(flat)
    ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))
    return np.array_equal(edges[ends], np.cumsum(list(map(len, written)))) and data.equals(pa.py_buffer(b"".join(written)))


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``a`` and ``b`` (``start``, ``place``; sorted by ``start``) whose spans overlap, as ``place_a`` and ``place_b``.

    Both sides cover the same bytes from 0 on, each with disjoint spans without gaps.
    """
    a, b = a.rename(columns={"place": "place_a"}), b.rename(columns={"place": "place_b"})
    both = pd.concat([pd.merge_asof(a, b, on="start"), pd.merge_asof(b, a, on="start")[["start", "place_a", "place_b"]]])
    # an overlap begins with the later of its two tokens, and at no byte does more than one
    begin = both["start"].to_numpy()
    order = np.argsort(begin, kind="stable")
    once = order[np.diff(begin[order], prepend=-1) > 0]
    return both[["place_a", "place_b"]].take(once).reset_index(drop=True)


@dataclass
class Aligned:
    """Tokens of texts laid end to end; those of one text are in a row, and those of one group."""

    a: np.ndarray
    b: np.ndarray
    #: of each text the number of tokens on both sides, and of groups
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    good: np.ndarray
    #: of each group the number of tokens on both sides, and its text
    group_a: np.ndarray
    group_b: np.ndarray
    group_text: np.ndarray
    #: overlapping tokens as places in ``a`` and ``b``
    overlap: pd.DataFrame


def align_texts(first: ByteLevel | Pieces, second: ByteLevel | Pieces, texts: list[str]) -> Aligned:
    """Align the tokens of each text, space included. A text that either side doesn't give back has no tokens."""
    sides = []
    given = Texts(texts)
    encoded = [encode_pieces(t, given) for t in (first, second)]
    good = encoded[0][2] & encoded[1][2]
    for tokenizer, (ids, count, _) in zip((first, second), encoded):
        if not good.all():
            ids, count = ids[np.repeat(good, count)], np.where(good, count, 0)
        size = tokenizer.spelled.sizes[ids]
        sides.append((ids, count, np.cumsum(size), size))
    (a, n_a, a_end, a_size), (b, n_b, b_end, b_size) = sides
    pairs = overlaps(*[pd.DataFrame({"start": end - size, "place": np.arange(len(end))}) for _, _, end, size in sides])
    at_a, at_b = pairs["place_a"].to_numpy(), pairs["place_b"].to_numpy()
    last = a_end[at_a] == b_end[at_b]  # the two end together: a group ends
    cut_a, cut_b = at_a[last] + 1, at_b[last] + 1
    text_of_group = np.repeat(np.arange(len(texts)), n_a)[cut_a - 1]
    return Aligned(
        a, b, n_a, n_b, np.bincount(text_of_group, minlength=len(texts)), good,
        np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0), text_of_group, pairs,
    )


def links(aligned: Aligned, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, ``a * wide + b``, occurrences) of the linked pairs of ids; a pair of a text may come in several rows."""
    first_a, first_b = np.cumsum(aligned.group_a) - aligned.group_a, np.cumsum(aligned.group_b) - aligned.group_b
    size = aligned.group_a * aligned.group_b
    short = np.flatnonzero(size <= LONG_GROUP)
    group = np.repeat(short, aligned.group_a[short])
    width = aligned.group_b[group]
    at_a = np.repeat(_ranges(first_a[short], aligned.group_a[short]), width)
    at_b = _ranges(first_b[group], width)
    texts, pairs, times = [aligned.group_text[np.repeat(group, width)]], [aligned.a[at_a] * wide + aligned.b[at_b]], [np.ones(len(at_a), np.int64)]
    for g in np.flatnonzero(size > LONG_GROUP).tolist():
        ids_a, n_a = np.unique(aligned.a[first_a[g] : first_a[g] + aligned.group_a[g]], return_counts=True)
        ids_b, n_b = np.unique(aligned.b[first_b[g] : first_b[g] + aligned.group_b[g]], return_counts=True)
        pairs.append((ids_a[:, None] * wide + ids_b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
        texts.append(np.full(len(pairs[-1]), aligned.group_text[g]))
    return np.concatenate(texts), np.concatenate(pairs), np.concatenate(times)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, …`` for ``count[0]`` values, and so on."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The values, none negative, in as few bytes each as the largest takes."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))).newbyteorder("<"))


def written_ids(wide_a: int, wide_b: int) -> Runs:
    """The ids of both sides in decimal, as ``group_strings`` takes them: of A before a comma, of A before a bar, of B before a comma, of
    B before a semicolon."""
    return Runs.of([b"%d%c" % (i, mark) for wide, last in ((wide_a, b"|"), (wide_b, b";")) for mark in b"," + last for i in range(wide)])


def group_strings(aligned: Aligned, written: Runs, wide_a: int, wide_b: int) -> Runs:
    """For each text its groups, as ``a1,a2|b1;a3|b2,b3;``: a semicolon follows each."""
    end_a, end_b = np.cumsum(aligned.group_a), np.cumsum(aligned.group_b)
    a, b = aligned.a.copy(), aligned.b + 2 * wide_a
    a[end_a - 1] += wide_a
    b[end_b - 1] += wide_b
    laid = np.empty(len(a) + len(b), np.int64)
    laid[np.arange(len(a)) + np.repeat(end_b - aligned.group_b, aligned.group_a)] = a
    laid[np.arange(len(b)) + np.repeat(end_a, aligned.group_b)] = b
    data, edges = written.laid(laid)
    return Runs.cut(data, edges[np.concatenate([[0], np.cumsum(aligned.n_a + aligned.n_b)])])


def cut_text(text: str) -> list[str]:
    """The text with a space before it, cut at single spaces between two other characters; these spaces are left out."""
    return _CUT.split(" " + text) if text else []


def cut_texts(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The pieces of all texts, and where those of each text begin and how many they are. The first may have left its space, too."""
    odd = pc.match_substring_regex(texts, _ODD)
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    others = [cut_text(text) for text in texts.filter(odd).to_pylist()]
    parts = pa.concat_arrays([plain.flatten(), pa.array(itertools.chain.from_iterable(others), pa.large_string())])
    is_odd = odd.to_numpy(zero_copy_only=False)
    count = np.zeros(len(texts), np.int64)
    count[~is_odd], count[is_odd] = plain.value_lengths().to_numpy(), list(map(len, others))
    order = np.concatenate([np.flatnonzero(~is_odd), np.flatnonzero(is_odd)])
    first = np.zeros(len(texts), np.int64)
    first[order] = np.cumsum(count[order]) - count[order]
    return parts, first, count


class Known:
    """Pieces of texts with their alignment, kept from block to block; beyond ``most`` those that came seldom are let go.

    A piece has left its space at the cut, and the one that begins a text may have it still.
    """

    #: Values of one piece, and the runs of values whose lengths are ``n_a``, ``n_b`` and ``n_links``.
    SINGLE = ("n_a", "n_b", "n_groups", "n_links", "good", "uses")
    RUNS = {"a": "n_a", "b": "n_b", "pair": "n_links", "times": "n_links"}

    def __init__(self, first: ByteLevel | Pieces, second: ByteLevel | Pieces, most: int = KNOWN_PIECES):
        self.sides, self.most, self.wide = (first, second), most, len(second.bytes)
        self.number: dict[str, int] = {}
        self.written = written_ids(len(first.bytes), self.wide)
        self.strings = Runs.of([])
        for name in (*self.SINGLE, *self.RUNS):
            setattr(self, name, np.empty(0, bool if name == "good" else np.int64))

    def look_up(self, parts: pa.LargeStringArray) -> np.ndarray:
        """The number of each part, aligning those that are new."""
        number = self.number
        encoded = parts.dictionary_encode()
        names = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in names if p not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self._add([p if p[0] == " " else " " + p for p in new[i : i + ALIGNED_AT_ONCE]] for i in range(0, len(new), ALIGNED_AT_ONCE))
        found = np.fromiter(map(number.__getitem__, names), np.int64, len(names))[encoded.indices.to_numpy()]
        self.uses = self.uses // 2 + np.bincount(found, minlength=len(number))
        return found

    def _add(self, chunks: Iterable[list[str]]) -> None:
        made = {name: [getattr(self, name)] for name in (*self.SINGLE, *self.RUNS)}
        strings = [self.strings.values]
        wide_a = len(self.sides[0].bytes)
        for texts in chunks:
            aligned = align_texts(*self.sides, texts)
            text, pair, times = links(aligned, self.wide)
            many = self.wide * wide_a
            key, times = _summed(text * many + pair, times)
            text, pair = np.divmod(key, many)
            added = {
                "n_a": aligned.n_a, "n_b": aligned.n_b, "n_groups": aligned.n_groups, "n_links": np.bincount(text, minlength=len(texts)),
                "good": aligned.good, "uses": np.zeros(len(texts), np.int64), "a": aligned.a, "b": aligned.b, "pair": pair, "times": times,
            }
            for name, values in added.items():
                made[name].append(values)
            strings.append(group_strings(aligned, self.written, wide_a, self.wide).values)
        for name in list(made):
            setattr(self, name, np.concatenate(made.pop(name)))
        self.strings = Runs(pa.concat_arrays(strings))

    def first(self, run: str) -> np.ndarray:
        """Where the values of each piece begin in a run."""
        count = getattr(self, self.RUNS[run])
        return np.cumsum(count) - count

    def let_go(self) -> None:
        """Numbers change where pieces go."""
        if len(self.number) <= self.most:
            return
        kept = np.sort(np.argpartition(-self.uses, self.most // 2)[: self.most // 2])
        for run, size in self.RUNS.items():
            setattr(self, run, getattr(self, run)[_ranges(self.first(run)[kept], getattr(self, size)[kept])])
        for name in self.SINGLE:
            setattr(self, name, getattr(self, name)[kept])
        self.strings = self.strings.take(kept)
        names = list(self.number)
        self.number = {names[k]: i for i, k in enumerate(kept.tolist())}


class _Block:
    """Documents cut into pieces; ``piece`` has their numbers among the known ones."""

    def __init__(self, known: Known, texts: pa.StringArray):
        parts, begin, self.count = cut_texts(texts.cast(pa.large_string()))
        self.known = known
        self.piece = known.look_up(parts)[_ranges(begin, self.count)]
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        bad = np.zeros(len(texts), bool)
        bad[self.doc[~known.good[self.piece]]] = True
        self.kept = ~bad & (self.count > 0)

    def sums(self, name: str) -> np.ndarray:
        totals = np.concatenate([[0], np.cumsum(getattr(self.known, name)[self.piece])])
        return np.where(self.kept, totals[self.first + self.count] - totals[self.first], 0)

    def ids(self, side: str) -> pa.ListArray:
        """The ids of each document on one side."""
        begin = self.known.first(side)[self.piece]
        n = np.where(self.kept[self.doc], getattr(self.known, Known.RUNS[side])[self.piece], 0)
        edges = np.concatenate([[0], np.cumsum(self.sums(Known.RUNS[side]))])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(getattr(self.known, side)[_ranges(begin, n)], pa.int64()))

    def strings(self) -> Iterator[memoryview]:
        """The groups of each document."""
        data, edges = self.known.strings.laid(self.piece)
        view = memoryview(data)
        for i, j, ok in zip(edges[self.first].tolist(), edges[self.first + self.count].tolist(), self.kept.tolist()):
            yield view[i : j - 1] if ok else view[:0]

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of the block, and (document, place among the pairs, occurrences) by document."""
        known = self.known
        inside = self.kept[self.doc]
        used, often = np.unique(self.doc[inside] * len(known.good) + self.piece[inside], return_counts=True)
        doc, piece = np.divmod(used, max(len(known.good), 1))
        first, size = known.first("pair"), known.n_links
        distinct = np.flatnonzero(np.bincount(piece, minlength=len(size)))
        entries = _ranges(first[distinct], size[distinct])
        pairs, inverse = np.unique(known.pair[entries], return_inverse=True)
        place = np.zeros(len(known.pair), np.int64)
        place[entries] = inverse
        # some documents at a time: each beginning is that of a document
        begin = np.unique(np.searchsorted(doc, doc[::LINKED_AT_ONCE])).tolist()
        made = [(np.empty(0, np.int32), np.empty(0, "<u4"), np.empty(0, np.int64))]
        for i, j in zip(begin, [*begin[1:], len(doc)]):
            each = size[piece[i:j]]
            entry = _ranges(first[piece[i:j]], each)
            key, total = _summed(np.repeat(doc[i:j] * len(pairs), each) + place[entry], np.repeat(often[i:j], each) * known.times[entry])
            of_doc, pair = np.divmod(key, max(len(pairs), 1))
            made.append((of_doc.astype(np.int32), pair.astype("<u4"), total))
        return pairs, *map(np.concatenate, zip(*made))


def _opened(first: str, second: str) -> Known:
    return Known(ByteLevel(first), Pieces(second))


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Each row's tokens on both sides and their groups, without a shuffle: ``doc_id``, ``a`` and ``b`` (ids), and ``groups``, the ids
    of each group as ``a1,a2|b1;a3|b2``. ``first`` and ``second`` are the paths of a byte-level and a sentence-piece tokenizer.

    A text that is null or empty, or that either side doesn't give back byte for byte, has no tokens. Repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened(first, second)
        for batch in pieces(batches, BLOCK_BYTES):
            block = _Block(known, batch.column(1))
            groups = pa.array([str(s, "ascii") for s in block.strings()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), block.ids("a"), block.ids("b"), groups], ["doc_id", "a", "b", "groups"])
            known.let_go()

    rows = id_and_text(docs)
    return rows.withColumn("doc_id", rows.doc_id.cast("long")).mapInArrow(lean(run), "doc_id long, a array<long>, b array<long>, groups string")


BLOCKS = (
    "part int, block int, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, a array<int>, b array<int>, n_docs array<int>, entries array<int>, entry_pair binary, entry_links binary"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in fields])


def _blocks(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row for each block of documents: numbers and digests by document, the distinct linked pairs with the number of documents that
    hold each, and for every document its pairs (``entries`` of them) with their links."""
    schema = _schema(BLOCKS)

    def row(known: Known, batch: pa.RecordBatch, *name: int) -> pa.RecordBatch:
        block = _Block(known, batch.column(1))
        pairs, doc, pair, times = block.linked()
        n, wide = batch.num_rows, known.wide
        sums = [block.sums(name) for name in ("n_a", "n_b", "n_groups")]
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, doc, times)
        held = np.bincount(pair, minlength=len(pairs))
        digest = [hashlib.sha256(s).hexdigest() if s else "" for s in block.strings()]
        values = [
            *name, batch.column(0).to_pylist(), *sums, n_links, digest, pairs // wide, pairs % wide, held,
            np.bincount(doc, minlength=n), pair.tobytes(), _narrow(times).tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = _opened(first, second), TaskContext.get().partitionId()
        for number, batch in enumerate(pieces(batches, BLOCK_BYTES)):
            yield row(known, batch, part, number)  # nothing of a block is held while the next is made
            known.let_go()

    rows = id_and_text(docs)
    return rows.withColumn("doc_id", rows.doc_id.cast("long")).mapInArrow(lean(run), BLOCKS)


def align_counted(docs: DataFrame, first: str, second: str) -> DataFrame:
    """The alignment of each row in numbers: ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (pairs of tokens that share a group),
    ``count_sum`` (over links, in how many documents of the whole table their pair of ids is linked), ``n_best`` (links whose count is the
    highest of their A id, ties included) and ``groups_sha256`` (of ``groups`` of ``align``; empty without tokens).

    Odd input is taken as by ``align``; every row counts as a document. A block of documents, some 4 MB of text or one row, is one row of a
    table in the shared folder; only its distinct pairs are shuffled, once for their sums and once to fetch them.
    """
    blocks = cut_lineage(_blocks(docs, first, second))
    held = blocks.select(F.explode(F.arrays_zip("a", "b", "n_docs")).alias("p")).select("p.*")
    counted = cut_lineage(held.groupBy("a", "b").agg(F.sum("n_docs").alias("n")))
    top = counted.groupBy("a").agg(F.max("n").alias("most"))  # one row for each id of the vocabulary at most
    known = counted.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.select("part", "block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("part", "block", "place", "p.a", "p.b")
    answered = asked.join(known, ["a", "b"]).groupBy("part", "block").agg(F.collect_list(F.struct("place", "n", "best")).alias("known"))
    kept = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries", "entry_pair", "entry_links"]
    joined = blocks.select("part", "block", *kept).join(answered, ["part", "block"], "left").select(*kept, "known")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                lists = {name: row[name].values for name in kept if not name.startswith("entry")}
                n = len(lists["doc_ids"])
                best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if row["known"].is_valid:
                    answers = row["known"].values
                    place, count, is_best = (answers.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    by_place, best_at = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
                    by_place[place], best_at[place] = count, is_best
                    pair, times = np.frombuffer(row["entry_pair"].as_buffer(), "<u4"), row["entry_links"].as_buffer()
                    times = np.frombuffer(times, f"<u{len(times) // max(len(pair), 1) or 1}").astype(np.int64)
                    doc = np.repeat(np.arange(n), lists["entries"].to_numpy())
                    np.add.at(best, doc, times * best_at[pair])
                    np.add.at(total, doc, times * by_place[pair])
                columns = [lists[c] for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(best), pa.array(total), lists["groups_sha256"]], [f.split()[0] for f in RESULT.split(", ")]
                )

    return joined.mapInArrow(lean(run), RESULT)
