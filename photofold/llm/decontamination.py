"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: tokens in lower case, with numbers, names and units replaced by
typed placeholders. Windows of template tokens are hash-joined, so that a question with other numbers or names
still matches. The slots of the matching windows must then agree: within one occurrence of the item, one of its
values stands for one value of the document throughout. Where an item has too few literal tokens for a window, the window grows, and the same
place is looked for by its exact tokens, too.

Before the join, windows of documents pass a bitmap of the benchmark's window hashes. The bitmap has a fixed
size; with more windows than it can tell apart more rows reach the join, and the result is the same.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photofold.llm.common import pieces, small_batches, text_tag
from photofold.llm.words import Bytes, _powers, lean, mix
from photofold.plans.hot_keys import broadcast_if_fits
from photofold.session import cut_lineage

WINDOW = 8
LEAST_WINDOW = 5
LEAST_LITERALS = 5
WHOLE_LITERALS = 3
LEAST_SHARE = 0.5
ENOUGH_TOKENS = 13
BITMAP_BITS = 24

NUMBER, NAME, UNIT = (np.uint64(0xA5A5000000000000 + k) for k in (1, 2, 3))
# Number words, and units that count as such after a number.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonnes oz lb lbs pound pounds ml l liter "
    "liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit kelvin w kw watt watts v volt volts "
    "j kj joule joules cal kcal hz khz mhz ghz byte bytes kb mb gb tb"
).split()


def window_size(tokens: int) -> int:
    """The least size of grown windows for so many tokens: all up to 16, then two for each doubling, so that documents are searched for
    few sizes, whatever the benchmark has."""
    if tokens <= 16:
        return tokens
    power = 1 << (tokens - 1).bit_length()
    return power * 3 // 4 if tokens <= power * 3 // 4 else power


def _same_length_lower(text: str) -> str:
    low = text.lower()
    if len(low.encode()) == len(text.encode()):
        return low
    return "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text)


class Templates:
    """Template tokens of many texts: ``start``, ``end``, ``doc`` and ``key``, and whether each is a ``slot``."""

    def __init__(self, texts: Sequence[str]):
        self._sums: dict[bool, np.ndarray] = {}
        self.bytes = b = Bytes([_same_length_lower(t).encode() for t in texts])
        data = b.data
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        n = len(data)
        if not n:
            self.start = self.end = self.doc = np.empty(0, np.int64)
            self.key, self.slot = np.empty(0, np.uint64), np.empty(0, bool)
            self.exact = self.key
            return
        digit = (data >= 48) & (data <= 57)
        token = digit | ((data >= 97) & (data <= 122)) | (data >= 0x80)
        # Marks beyond ASCII: U+00A0 to U+00BF but for three letters, and general punctuation.
        at = np.flatnonzero(data[:-1] == 0xC2)
        at = at[~np.isin(data[at + 1], [0xAA, 0xB5, 0xBA])]
        token[at] = token[at + 1] = False
        at = np.flatnonzero(data[:-2] == 0xE2)
        at = at[(data[at + 1] == 0x80) | (data[at + 1] == 0x81)]
        token[at] = token[at + 1] = token[at + 2] = False
        at = np.flatnonzero((data == 46) | (data == 44))
        at = at[(at > 0) & (at < n - 1)]
        token[at[digit[at - 1] & digit[at + 1]]] = True
        first, last = token.copy(), token.copy()
        first[1:] &= ~token[:-1]
        last[:-1] &= ~token[1:]
        real = b.start < b.end
        edges, ends = b.start[real], b.end[real] - 1
        first[edges], last[ends] = token[edges], token[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(b.end, self.start, "right")
        self.key = self.exact = b.hashes(self.start, self.end)
        count = len(self.start)

        digits = np.concatenate([[0], np.cumsum(digit)])
        fixed = Bytes([w.encode() for w in (*NUMBER_WORDS, *UNITS)])
        known = fixed.hashes(fixed.start, fixed.end)
        number = (digits[self.end] > digits[self.start]) | np.isin(self.key, known[: len(NUMBER_WORDS)])
        after = np.zeros(count, bool)
        after[1:] = number[:-1] & (self.doc[1:] == self.doc[:-1])
        unit = after & ~number & np.isin(self.key, known[len(NUMBER_WORDS) :])
        # A capital that doesn't begin a sentence: the last byte before that isn't a space decides.
        ink = np.where((data == 32) | (data == 9) | (data == 13), -1, np.arange(n))
        ink = np.concatenate([[-1], np.maximum.accumulate(ink)])[self.start]
        begins = (ink < b.start[self.doc]) | np.isin(data[np.maximum(ink, 0)], np.frombuffer(b".!?:;\n\"(|", np.uint8))
        # Capitals throughout are a way of writing, not names: the second letter must be a small one.
        changed = np.concatenate([[0], np.cumsum(raw != data)])
        lead = data[self.start]
        after_first = np.minimum(self.start + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), self.end)
        lead = data[np.minimum(after_first, n - 1)]
        after_second = np.minimum(after_first + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), self.end)
        upper = changed[after_first] > changed[self.start]
        small = (after_second > after_first) & (changed[after_second] == changed[after_first])
        name = upper & small & ~begins & ~number & ~unit
        self.key = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, self.key)))
        self.slot = number | name | unit
        self.literals = np.concatenate([[0], np.cumsum(~self.slot)])

    def windows(self, size: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First tokens of the windows that lie in one text, and the windows' hashes, by template or by exact tokens."""
        n = len(self.key) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        power, inverse = _powers(len(self.key) + 1)
        if exact not in self._sums:
            values = mix(self.exact if exact else self.key)
            self._sums[exact] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)])
        sums = self._sums[exact]
        at = self.doc[:n] == self.doc[size - 1 :]
        if not exact:
            at &= self.literals[size:] - self.literals[:-size] >= WHOLE_LITERALS
        at = np.flatnonzero(at)
        salt = (2 * size + exact) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return at, mix((sums[at + size] - sums[at]) * inverse[at] + np.uint64(salt))

    def item_places(self, window: int) -> list[tuple[int, int, bool]]:
        """First token, size and exactness of the windows of a single text, which is an item.

        A window with fewer than ``LEAST_LITERALS`` literal tokens stands by its exact tokens, and grows to the
        right until it has so many, and on to the next ``window_size``; where the text ends before, it grows to the left. A text that has
        fewer in all is one window by template if it has ``WHOLE_LITERALS`` of them.
        """
        n, found = len(self.key), {}
        size = min(window, n)
        literals = self.literals

        def grown(first: int, end: int) -> None:
            """A window of a usual size around these tokens; where the text is shorter, the largest that fit at both of its ends."""
            wide = window_size(end - first)
            if wide <= n:
                found[min(first, n - wide), wide, False] = None
                return
            while (wide := wide - 1) > n or window_size(wide) != wide:
                pass
            for at in (0, n - wide):
                if literals[at + wide] - literals[at] >= WHOLE_LITERALS:
                    found[at, wide, False] = None

        for a in range(n - size + 1):
            if literals[a + size] - literals[a] >= LEAST_LITERALS:
                found[a, size, False] = None
                continue
            found[a, size, True] = None
            end = int(np.searchsorted(literals, literals[a] + LEAST_LITERALS))
            if end <= n:
                grown(a, end)
            elif literals[n] >= LEAST_LITERALS:
                grown(int(np.searchsorted(literals, literals[n] - LEAST_LITERALS, "right")) - 1, n)
            elif literals[n] >= WHOLE_LITERALS:
                grown(0, n)
        return list(found)

    def slots(self, first: int, size: int, exact: bool = False) -> list[str]:
        """Values of the window's slots, null string at its literals; exact windows have nothing left to compare."""
        if exact:
            return [""] * size
        raw = self.bytes.data
        return [
            raw[self.start[k] : self.end[k]].tobytes().decode() if self.slot[k] else ""
            for k in range(first, first + size)
        ]


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``item_id``, ``n_tokens``, ``hash``, ``size``, ``exact``, ``at`` and ``slots`` of all windows; a shorter item is one window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("item_id", pa.int64()), ("n_tokens", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()),
             ("exact", pa.bool_()), ("at", pa.int32()), ("slots", pa.list_(pa.string()))]
        )
        for batch in pieces(batches, 1 << 20):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = Templates([text])
                n = len(t.key)
                if n < LEAST_WINDOW:
                    continue
                hashes: dict[tuple[int, bool], dict[int, int]] = {}
                for a, size, exact in t.item_places(window):
                    if (size, exact) not in hashes:
                        at, h = t.windows(size, exact)
                        hashes[size, exact] = dict(zip(at.tolist(), h.view(np.int64).tolist()))
                    h = hashes[size, exact][a]
                    rows.append(dict(zip(schema.names, (item, n, h, size, exact, a, t.slots(a, size, exact)))))
            yield pa.RecordBatch.from_pylist(rows, schema)

    whole = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(lean(run), "item_id long, n_tokens int, hash long, size int, exact boolean, at int, slots array<string>")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the windows' hashes, in pieces of 4 KB, at most ``2**BITMAP_BITS`` bits in all."""
    bit = F.shiftrightunsigned("hash", 64 - BITMAP_BITS) + 1
    rows = (
        windows.groupBy(F.bitmap_bucket_number(bit).alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << BITMAP_BITS >> 3, np.uint8)
    for row in rows:
        at = (row.piece - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _document_windows(docs: DataFrame, kinds: list[tuple[int, bool]], bitmap) -> DataFrame:
    """``doc_id``, ``tag`` (of its text), ``place``, ``hash``, ``slots``: windows of documents whose hash the bitmap has; ``place`` counts tokens.

    Windows without slots agree wherever they stand: their place is -1, so that repeated ones are one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("tag", pa.int64()), ("place", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))]
        )
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in pieces(batches, 1 << 19):
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            t = Templates(batch.column(2).to_pylist())
            first = np.searchsorted(t.doc, np.arange(len(ids)))
            rows = []
            for size, exact in kinds:
                at, hashes = t.windows(size, exact)
                place = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                found = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                for a, h in zip(at[found].tolist(), hashes[found].view(np.int64).tolist()):
                    slots = t.slots(a, size, exact)
                    place = a - int(first[t.doc[a]]) if any(slots) else -1
                    rows.append(dict(zip(schema.names, (ids[t.doc[a]], tags[t.doc[a]], place, h, slots))))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    small_batches(docs.sparkSession)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(F.col("text")).alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(lean(run), "doc_id long, tag long, place int, hash long, slots array<string>")


def _votes(windows: list[dict]) -> dict[str, str]:
    """The most frequent value for each item value; of equally frequent ones the item's own, then the largest."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for w in windows:
        for mine, theirs in zip(w["item_slots"], w["slots"]):
            if mine:
                votes[mine][theirs] += w["times"]
    return {mine: max(c.items(), key=lambda x: (x[1], x[0] == mine, x[0]))[0] for mine, c in votes.items()}


def _agrees(w: dict, stands_for: dict[str, str]) -> bool:
    """Whether the window's values are the item's own, or those that stand for them."""
    pairs = [(m, t) for m, t in zip(w["item_slots"], w["slots"]) if m]
    known: dict[str, str] = {}
    return all(m == t for m, t in pairs) or all(known.setdefault(m, stands_for.get(m, t)) == t for m, t in pairs)


def _tokens(windows: Iterable[dict]) -> set[int]:
    return {k for w in windows for at in w["at"] for k in range(at, at + len(w["slots"]))}


def consistent_tokens(windows: list[dict]) -> int:
    """Item tokens covered by windows whose slots agree with the most frequent value for each item value."""
    stands_for = _votes(windows)
    return len(_tokens(w for w in windows if _agrees(w, stands_for)))


def best_covered(windows: list[dict], n_tokens: int) -> int:
    """The most item tokens that windows cover which agree, in one occurrence or in the document as a whole.

    An occurrence is a diagonal, of windows with one distance between ``place`` in the document and in the item. Around it
    come windows of the diagonals near by, the nearest first, which agree with those before: words put in or left out shift
    the rest of an occurrence. Windows with the item's own values, or without slots, count with each occurrence.
    """
    best, own = consistent_tokens(windows), _tokens(w for w in windows if w["slots"] == w["item_slots"])
    diagonals: dict[int, list[dict]] = defaultdict(list)
    for w in windows:
        if w["place"] >= 0:
            diagonals[w["place"] - w["at"][0]].append(w)
    order = sorted(diagonals)
    for d in order:
        if best >= n_tokens:
            break
        stands_for = _votes(diagonals[d])
        covered = set(own)
        near = order[bisect_left(order, d - n_tokens) : bisect_right(order, d + n_tokens)]
        for other in sorted(near, key=lambda x: (abs(x - d), x)):
            for w in diagonals[other]:
                if _agrees(w, stands_for):
                    covered |= _tokens([w])
                    for m, t in zip(w["item_slots"], w["slots"]):
                        if m:
                            stands_for.setdefault(m, t)
        best = max(best, len(covered))
    return best


def _named_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``find_leaks`` with the ``tag`` of the text, which tells rows with one id apart."""
    spark = docs.sparkSession
    known = item_windows(items, window).groupBy("hash", "item_id", "at").agg(
        F.max("n_tokens").alias("n_tokens"), F.min("size").alias("size"), F.min("exact").alias("exact"), F.min("slots").alias("item_slots")
    )
    known = cut_lineage(known)
    kinds = [(row["size"], row["exact"]) for row in known.select("size", "exact").distinct().orderBy("size", "exact").collect()]
    bitmap = spark.sparkContext.broadcast(_bitmap(known).tobytes())
    found = _document_windows(docs, kinds, bitmap)
    hits = found.distinct().withColumn("times", F.lit(1)).join(known, "hash")
    window_type = F.struct("hash", "place", "slots", "item_slots", F.array("at").alias("at"), "times")
    groups = hits.groupBy("doc_id", "tag", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.collect_list(window_type).alias("windows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            lists = batch.column(batch.schema.get_field_index("windows"))
            windows, covered = [], []
            for k, n_tokens in enumerate(columns[3].to_pylist()):
                x = lists[k].as_py()
                windows.append(len({(w["hash"], *w["slots"]) for w in x}))
                covered.append(best_covered(x, n_tokens))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(windows, pa.int64()), pa.array(covered, pa.int32())],
                ["doc_id", "tag", "item_id", "n_tokens", "n_windows", "n_covered"],
            )

    counted = groups.select("doc_id", "tag", "item_id", "n_tokens", "windows").mapInArrow(
        lean(run), "doc_id long, tag long, item_id long, n_tokens int, n_windows long, n_covered int"
    )
    return counted.filter((F.col("n_covered") >= LEAST_SHARE * F.col("n_tokens")) | (F.col("n_covered") >= ENOUGH_TOKENS))


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents that hold a benchmark item, or a good part of one.

    One row per document and item: ``doc_id``, ``item_id``, ``n_windows`` (distinct), ``n_covered`` and ``n_tokens`` (of the item),
    where slot-consistent windows of one occurrence, or of the document as a whole, cover at least half of the item's tokens or ``ENOUGH_TOKENS`` of them.
    Documents without a leak have no row. Windows have ``window`` tokens, with ``LEAST_LITERALS`` that are no slots;
    an item of fewer tokens is one window. Windows with fewer literals grow until they have so many, and count as they
    stand where the document has the same tokens. An item with too few in all is one window as a whole, with
    ``WHOLE_LITERALS``, or found by its exact tokens. One of under ``LEAST_WINDOW`` tokens is passed over here: ``find_short_items`` lists
    where it stands as a whole sentence, which many clean texts may hold by chance.

    A null text is empty. Rows that share an id (null is one, too) are documents of their own if their texts differ;
    items that share one count as one.
    Repeated items give repeated findings for other ids only. Other columns are ignored. Without documents or
    items the result is empty.
    """
    return _named_leaks(docs, items, window).drop("tag")


#: What ends a sentence or line, and what stands between its tokens; a point or comma between digits belongs to a number.
_SENTENCE_END = r"[\n!?;]+|[.:](?![0-9])"
_BETWEEN = r"(?:[^\p{L}\p{N}.,]|[.,](?![0-9])|(?<![0-9])[.,])+"


def _sentences(text: Column) -> Column:
    """The sentences and lines of a text, each as its tokens in lower case with one space between."""
    return F.transform(F.split(F.lower(text), _SENTENCE_END), lambda s: F.btrim(F.regexp_replace(s, _BETWEEN, " ")))


def find_short_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id`` and ``n_times``: items of one sentence with under ``LEAST_WINDOW`` tokens, and how often one of a
    document's sentences or lines has exactly their tokens ("3 + 4 = 7" has three).

    Kept apart from ``find_leaks``: so short a sentence is no proof. Null texts are empty, items without a token or with more sentences are
    left out, rows that share an id are added up, and an empty table gives an empty result. Built-in functions only; a document's long sentences
    go before the shuffle.
    """
    def short(sentence: Column) -> Column:
        return (sentence != "") & (F.size(F.split(sentence, " ")) < LEAST_WINDOW)

    whole = F.filter(_sentences(F.coalesce("text", F.lit(""))), lambda s: s != "")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), whole.alias("own")).filter(F.size("own") == 1)
    asked = cut_lineage(asked.select("item_id", F.get("own", F.lit(0)).alias("sentence")).filter(short(F.col("sentence"))).distinct())
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_sentences(F.coalesce("text", F.lit("")))).alias("sentence"))
    told = each.filter(short(F.col("sentence"))).groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n_times"))
    found = told.join(broadcast_if_fits(asked), "sentence")
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_times").alias("n_times"))


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no leak, by id and text; all columns are kept."""
    leaks = cut_lineage(_named_leaks(docs, items, **options).select("doc_id", "tag").distinct())
    on = F.col("_docs.doc_id").cast("long").eqNullSafe(F.col("_leaks.doc_id")) & (text_tag(F.col("_docs.text")) == F.col("_leaks.tag"))
    return docs.alias("_docs").join(broadcast_if_fits(leaks).alias("_leaks"), on, "left_anti")
