"""Quality rules: word and line counts, and repetition measured with a suffix array.

The suffix array of a text's words (only of positions where at least ``MIN_REPEAT`` words occur again in
the same text; no other can start a longer repeat) is built by prefix doubling for a whole batch of texts
at once. Neighbours' longest common prefixes give for each position the longest repeat that begins there:
the depth of the deepest LCP interval that holds it. The union of these spans is that of all maximal
repeats, since every maximal repeat begins at such a position and every such span lies in a maximal one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photofold.llm.common import pieces, small_batches
from photofold.llm.words import Words, covered, lean, mix, per_text, repeated

MIN_WORDS = 50
MIN_REPEAT = 8
MOST_COVERED = 0.3
LONGEST_REPEAT = 0.2
SYMBOLS = b"#*$%&|<>"

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "covered_words long, longest_repeat long, kept boolean"
)


def suffix_repeats(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the sequence of ``keys``, where suffixes end at the end of their ``group``.

    Only suffixes whose first key occurs again in the group take part. Returns their positions in suffix
    order, the longest common prefix of each with the one before it (0 for the first of a group or where
    nothing is shared), and for each the longest prefix that occurs elsewhere in the group.
    """
    n = len(keys)
    live = np.flatnonzero(repeated(keys, group))
    rank = -1 - np.arange(n, dtype=np.int64)  # keys without a partner differ from all others
    if not len(live):
        return live, live, live
    _, first = np.unique(mix(keys[live]) ^ mix(group[live].astype(np.uint64) + np.uint64(1)), return_inverse=True)
    rank[live] = first
    ranks, step, order = [rank], 1, live[np.argsort(first, kind="stable")]
    while True:
        rank = ranks[-1]
        beyond = order + step
        ok = (beyond < n) & (group[np.minimum(beyond, n - 1)] == group[order])
        second = np.where(ok, rank[np.minimum(beyond, n - 1)], -1 - n - order)
        place = np.lexsort((second, rank[order]))
        order, second = order[place], second[place]
        own = rank[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])])
        if new.all():
            break
        longer = -1 - np.arange(n, dtype=np.int64)
        longer[order] = np.cumsum(new) - 1
        ranks.append(longer)
        step *= 2
    # Common prefixes of neighbours, from the largest step down.
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(left), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        inside = (left < n) & (right < n)
        a, b = np.minimum(left, n - 1), np.minimum(right, n - 1)
        equal = inside & (ranks[level][a] == ranks[level][b])
        shared[equal] += step
        left[equal] += step
        right[equal] += step
    lcp = np.concatenate([[0], shared])
    longest = np.maximum(lcp, np.concatenate([shared, [0]]))
    return order, lcp, longest


def measure(texts: Sequence[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of each text (UTF-8)."""
    w = Words(texts)
    b, data, n = w.bytes, w.bytes.data, len(texts)
    if not len(data):
        zero = np.zeros(n, np.int64)
        names = "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat"
        return {name: zero for name in names.split()}
    in_words = np.flatnonzero(w.inside & ((data & 0xC0) != 0x80))
    symbol = np.flatnonzero(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))

    # Lines that hold a word; a line's first occurrence is the earliest of its equals.
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(b.start[b.start < b.end], breaks + 1)
    starts = starts[starts < len(data)]
    line_doc = np.searchsorted(b.end, starts, "right")
    following = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(breaks, len(data))[following], b.end[line_doc])
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    line_key = b.hashes(starts, ends)
    order = np.lexsort((starts, line_key, line_doc))
    same = (line_key[order][1:] == line_key[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])

    hashes = w.hashes()
    at, windows = w.windows(hashes, 3)
    again = at[repeated(windows, w.doc[at])]
    in_windows = covered(again, np.full(len(again), 3), len(hashes))

    at, windows = w.windows(hashes, min_repeat)
    order_, _, longest = suffix_repeats(windows, w.doc[at])
    # Windows of one text are consecutive, so a shared run of k windows is one of k + min_repeat - 1 words.
    found = longest > 0
    begin, length = at[order_[found]], longest[found] + min_repeat - 1
    most = np.zeros(n, np.int64)
    np.maximum.at(most, w.doc[begin], length)
    return {
        "n_words": w.count,
        "word_chars": per_text(in_words, b.end),
        "n_symbols": per_text(symbol, b.end),
        "n_dup_lines": np.bincount(line_doc[order][1:][same], minlength=n),
        "n_repeat_words": np.bincount(w.doc[in_windows], minlength=n),
        "covered_words": np.bincount(w.doc[covered(begin, length, len(hashes))], minlength=n),
        "longest_repeat": most,
    }


def quality(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_repeat: int = MIN_REPEAT,
    most_covered: float = MOST_COVERED,
    longest_repeat: float = LONGEST_REPEAT,
) -> DataFrame:
    """Each row with its counts and ``kept``; needs a ``text`` column and no shuffle.

    ``base_failed``: under ``min_words`` words, or more than half of them in 3-word windows that occur twice.
    Rejected besides: texts of which repeats of ``min_repeat`` words or more cover over ``most_covered`` of
    the words, or whose longest repeat has over ``longest_repeat`` of them. A null text has no words and
    fails. All columns are kept; input columns named like a result are replaced. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    made = [c.split() for c in COLUMNS.split(", ")]
    docs = docs.drop(*[name for name, _ in made])
    fields = {f.name.lower() for f in docs.schema.fields}
    key = next(name for name in ("_measured", "_measured_text", "_measured_whole_text") if name not in fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 19, key):
            texts = [t or b"" for t in batch.column(batch.schema.get_field_index(key)).to_pylist()]
            m = measure(texts, min_repeat)
            n, repeats = m["n_words"], m["n_repeat_words"]
            m["base_failed"] = (n < min_words) | (100 * repeats > 50 * n)
            bad = (m["covered_words"] > most_covered * n) | (m["longest_repeat"] > longest_repeat * n)
            m["kept"] = ~m["base_failed"] & ~bad
            rest = [i for i, name in enumerate(batch.schema.names) if name != key]
            columns = [*(batch.column(i) for i in rest), *(pa.array(m[name]) for name, _ in made)]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in rest), *(x for x, _ in made)])

    schema = StructType(docs.schema.fields + StructType.fromDDL(COLUMNS).fields)
    return docs.withColumn(key, F.coalesce(F.col("text"), F.lit("")).cast("binary")).mapInArrow(lean(run), schema)
