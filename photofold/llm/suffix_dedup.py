"""Repeated substrings from sparse suffix arrays and their common-prefix interval trees.

1. Anchors. Of the ``GRAM``-byte grams in every window of ``length`` bytes the least by hash is an anchor, so equal
   windows have equal anchors at equal offsets. Only suffixes that begin at anchors are indexed: about one in 85
   bytes. An anchor's context is all text that windows of ``length`` bytes around it can reach.
2. Anchors with one gram are aggregated. Contexts that are equal to the byte are one class: a repeat with all
   its occurrences, however many.
3. Grams with several classes: their classes' contexts are sorted by the text from the anchor on (the suffix array),
   a stack scan over the common prefixes of neighbours yields the tree of LCP intervals, and in each interval
   the common lengths to the left are scanned in the same way. An interval of the left order whose members come from
   more than one child of the right interval is a maximal repeat: it can be extended neither to the right nor, its
   left extensions being diverse, to the left. It is reported with all members.
4. A gram with more than ``most`` classes is split: the windows around it are cut into segments, each segment's
   common core becomes a longer gram, and the classes go round again under their cores. In the last round the core is
   the whole window and equal windows are simply counted. So no group outgrows a task, and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photofold.llm.common import pieces, task_count
from photofold.llm.spans import cut_spans, named_bytes, with_lists
from photofold.llm.words import Bytes, lean, mix
from photofold.session import cut_lineage

LENGTH = 200
GRAM = 32
MOST = 64
SPLITS = (34, 6, 1)

OCCURRENCE = "doc_id long, tag long, start long, end long, repeat long, copies long"


def anchors(texts: Sequence[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of all texts: ``doc`` (index), ``pos``, bytes to the ``left`` and ``right``, ``gram`` and ``context`` hashes."""
    b = Bytes(texts)
    n, width = len(b.data), length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return {"doc": none, "pos": none, "left": none, "right": none, "gram": none, "context": none}
    hashes = b.every(gram)
    rows = np.full(-(-(len(hashes) + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    packed = rows[: len(hashes)]
    np.bitwise_and(hashes, np.uint64(0xFFFFFFFF00000000), out=packed)
    packed |= np.arange(len(hashes), dtype=np.uint64)
    rows = rows.reshape(-1, width)
    forth = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(back[:windows], forth[width - 1 : width - 1 + windows])
    inside = np.arange(windows) <= np.repeat(b.end - length, b.end - b.start)[:windows]
    at = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    pos = at[np.append(True, at[1:] != at[:-1])] if len(at) else at  # the least of a moving window moves forth only
    doc = np.searchsorted(b.end, pos, "right")
    left = np.minimum(pos - b.start[doc], width - 1)
    right = np.minimum(b.end[doc] - pos, length)
    context = mix(b.hashes(pos - left, pos + right) + (left * 4096 + right).astype(np.uint64))
    return {
        "doc": doc, "pos": pos - b.start[doc], "left": left, "right": right,
        "gram": hashes[pos].view(np.int64), "context": context.view(np.int64),
    }


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 19):
            a = anchors(batch.column(2).to_pylist(), length, gram)
            if not len(a["pos"]):
                continue
            row = pa.array(a["doc"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(a["pos"].astype(np.int64)),
                 pa.array(a["left"].astype(np.int32)), pa.array(a["right"].astype(np.int32)), pa.array(a["gram"]), pa.array(a["context"])],
                ["doc_id", "tag", "pos", "left", "right", "gram", "context"],
            )

    return named_bytes(docs).mapInArrow(lean(run), "doc_id long, tag long, pos long, left int, right int, gram long, context long")


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, at most ``most``."""
    unlike = a != b
    first = unlike.argmax(axis=1)
    return np.minimum(np.where(unlike[np.arange(len(a)), first], first, a.shape[1]), most)


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def lcp_intervals(lcp: Sequence[int], low: int, high: int) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """Stack scan over suffixes ``low`` to ``high`` (exclusive): (common prefix, first, last, children) of each interval.

    ``lcp[i]`` belongs to suffixes i - 1 and i. Children are runs of suffixes that share more; intervals come after
    their children.
    """
    stack: list[list] = []  # [lcp, first, children]
    for i in range(low + 1, high + 1):
        now = lcp[i] if i < high else -1
        begin, done = i - 1, (i - 1, i - 1)
        while stack and stack[-1][0] > now:
            depth, begin, children = stack.pop()
            children.append(done)
            done = (begin, i - 1)
            yield depth, begin, i - 1, children
        if now < 0:
            break
        if stack and stack[-1][0] == now:
            stack[-1][2].append(done)
        else:
            stack.append([now, begin, [done]])


def maximal_repeats(
    contexts: Sequence[bytes], left: Sequence[int], groups: Sequence[int], length: int
) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of maximal repeats of ``length`` bytes or more around the anchors.

    ``contexts[i]`` has its anchor ``left[i]`` bytes in; contexts of one group are consecutive and share the gram.
    """
    if not len(contexts):
        return
    after = [c[x:] for c, x in zip(contexts, left)]
    before = [c[:x][::-1] for c, x in zip(contexts, left)]
    order = sorted(range(len(after)), key=lambda i: (groups[i], after[i]))
    by_left = sorted(range(len(after)), key=lambda i: (groups[i], before[i]))

    def neighbours(strings: list[bytes], order: list[int]) -> list[int]:
        sizes = np.array([len(strings[i]) for i in order], np.int64)
        out = np.zeros(len(order), np.int64)
        for x in range(0, len(order), 4096):
            part = order[max(x - 1, 0) : x + 4096]
            table = _matrix([strings[i] for i in part], max(1, int(sizes.max())))
            own = sizes[max(x - 1, 0) : x + 4096]
            found = _common(table[1:], table[:-1], np.minimum(own[1:], own[:-1]))
            out[max(x - 1, 0) + 1 : x + 4096] = found
        return out.tolist()

    lcp, left_lcp = neighbours(after, order), neighbours(before, by_left)
    rank = [0] * len(order)
    for k, i in enumerate(by_left):
        rank[i] = k
    start = 0
    while start < len(order):
        stop = start
        while stop < len(order) and groups[order[stop]] == groups[order[start]]:
            stop += 1
        for right, first, last, children in lcp_intervals(lcp, start, stop):
            need = length - right
            members = sorted((rank[order[k]], k) for k in range(first, last + 1))
            shared = [0] + [min(left_lcp[a + 1 : b + 1]) for (a, _), (b, _) in zip(members, members[1:])]
            if max(shared) < need or len(members) < 2:
                continue
            child = {k: c for c, (x, y) in enumerate(children) for k in range(x, y + 1)}
            for common, x, y, _ in lcp_intervals(shared, 0, len(members)):
                if common >= need and len({child[k] for _, k in members[x : y + 1]}) > 1:
                    yield common, right, [order[k] for _, k in members[x : y + 1]]
        start = stop


#: Rows of a level: classes of contexts. A class of one occurrence is at (doc_id, tag, pos).
CLASS = "gram long, context long, doc_id long, tag long, pos long, left int, right int, copies long, bytes binary"


def _intervals(classes: DataFrame, length: int, groups: bool) -> DataFrame:
    """Occurrences of maximal repeats among the classes of each gram, one row for each member class; or only the union
    of their spans for each class of one occurrence (they all hold its anchor)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("repeat", pa.int64()), ("copies", pa.int64())]
    )

    def found(rows: pa.Table) -> pa.RecordBatch:
        column = {c: rows.column(c).to_pylist() for c in ("doc_id", "tag", "pos", "left", "gram", "context", "copies", "bytes")}
        out: list[tuple] = []
        reach: dict[int, tuple[int, int]] = {}
        for left, right, members in maximal_repeats(column["bytes"], column["left"], column["gram"], length):
            if not groups:
                for i in members:
                    far = reach.get(i, (0, 0))
                    reach[i] = (max(far[0], left), max(far[1], right))
                continue
            one = min(column["context"][i] for i in members)
            name = int(mix(np.array([one, left, right], np.int64).view(np.uint64)).sum().astype(np.int64))
            for i in members:
                pos = column["pos"][i]
                out.append((column["doc_id"][i], column["tag"][i], pos - left, pos + right, name, column["copies"][i]))
        for i, (left, right) in reach.items():
            if column["copies"][i] == 1:
                pos = column["pos"][i]
                out.append((column["doc_id"][i], column["tag"][i], pos - left, pos + right, column["context"][i], 1))
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            grams = held.column("gram").to_numpy()
            whole = int(np.searchsorted(grams, grams[-1]))  # the last gram may go on in the next batch
            if whole >= 2000:
                yield found(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield found(held)

    ordered = classes.repartition(task_count(classes), "gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(lean(run), OCCURRENCE)


def _split(classes: DataFrame, length: int, reach: int, width: int) -> DataFrame:
    """Classes of hot grams under the cores of segments of ``width`` windows; ``reach``: bytes that a window can have before
    the anchor."""
    last = width == 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "doc_id", "tag", "pos", "left", "right", "copies", "bytes"]
        for batch in pieces(batches, 1 << 19, "bytes"):
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            b = Bytes(column["bytes"].to_pylist())
            left, right, pos, gram = (column[c].to_numpy() for c in ("left", "right", "pos", "gram"))
            for k in range(-(-(reach + 1) // width)):
                near = k * width  # the segment's windows begin near .. far bytes before the anchor
                far = min(near + width - 1, reach)
                row = np.flatnonzero((near <= left) & (right >= length - far))
                if not len(row):
                    continue
                anchor = b.start[row] + left[row]
                core = b.hashes(anchor - near, anchor - far + length)
                key = mix(core ^ mix(gram[row].view(np.uint64) + np.uint64(k)))
                begin = np.maximum(anchor - far, b.start[row])
                end = np.minimum(anchor - near + length, b.end[row])
                new_left, new_right = anchor - near - begin, end - anchor + near
                context = mix(b.hashes(begin, end) + (new_left * 4096 + new_right).astype(np.uint64))
                take = pa.array(row)
                kept = [b""] * len(row) if last else [b.data[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), column["doc_id"].take(take), column["tag"].take(take),
                     pa.array(pos[row] - near), pa.array(new_left.astype(np.int32)), pa.array(new_right.astype(np.int32)),
                     column["copies"].take(take), pa.array(kept, pa.binary())],
                    names,
                )

    return classes.mapInArrow(lean(run), CLASS)


def repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    most: int = MOST,
    splits: Sequence[int] = SPLITS,
    groups: bool = True,
) -> DataFrame:
    """Occurrences of repeated substrings of ``length`` bytes or more: ``doc_id``, ``tag`` (of the row, see ``spans``),
    ``start``, ``end`` (bytes), ``repeat`` (its id) and ``copies`` (occurrences for which the row stands).

    Every window of ``length`` bytes that begins in more than one place lies in a reported occurrence at each of these
    places, and no reported span holds a byte outside such windows. A repeat that goes beyond an anchor's context is reported in
    overlapping parts, one per anchor. With ``groups`` off, of the maximal repeats around one anchor only the union of their spans
    is reported: the same bytes in fewer rows.
    """
    rows = anchor_rows(docs, length, gram)
    grams = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    # Sums are stored before a join on their key, else a hot gram couldn't be split in that join.
    grams = cut_lineage(grams.filter("n > 1").select("gram", F.col("low").eqNullSafe(F.col("high")).alias("pure")))
    again = cut_lineage(rows.join(grams, "gram"))
    whole = [F.col("pos") - F.col("left"), F.col("pos") + F.col("right")]
    occurrence = ["doc_id", "tag", whole[0].alias("start"), whole[1].alias("end"), F.col("context").alias("repeat"), F.lit(1).cast("long").alias("copies")]
    found = [again.filter("pure").select(*occurrence)]

    mixed = again.filter("not pure")
    place = F.struct("doc_id", "tag", "pos", "left", "right")
    classes = mixed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at"))
    classes = cut_lineage(classes)
    found.append(mixed.join(classes.filter("copies > 1").select("gram", "context"), ["gram", "context"], "left_semi").select(*occurrence))
    open_ = classes.groupBy("gram").agg(F.sum(F.when(F.col("copies") == 1, 1).otherwise(0)).alias("single")).filter("single > 0")
    wanted = classes.join(cut_lineage(open_.select("gram")), "gram", "left_semi").select("gram", "context", "copies", "at.*")
    level = cut_lineage(_contexts(docs, wanted))

    reach = length - gram
    for width in [*splits, None]:
        if width is None:  # whole windows: a gram has one class
            break
        sizes = level.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"))
        sized = level.join(cut_lineage(sizes.filter("classes > 1")), "gram")
        found.append(cut_lineage(_intervals(sized.filter(F.col("classes") <= most).drop("classes"), length, groups)))
        members = cut_lineage(_split(sized.filter(F.col("classes") > most).drop("classes"), length, reach, width))
        reach = width - 1
        at = F.struct("doc_id", "tag", "pos", "left", "right")
        merged = members.groupBy("gram", "context").agg(F.sum("copies").alias("copies"), F.min(at).alias("at"), F.first("bytes").alias("bytes"))
        merged = cut_lineage(merged)
        equal = merged.filter("copies > 1").select("gram", "context")
        found.append(members.filter("copies = 1").join(equal, ["gram", "context"], "left_semi").select(*occurrence))
        level = merged.select("gram", "context", "at.*", "copies", "bytes")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The classes with the bytes of their contexts."""
    item = F.struct("gram", "context", "pos", "left", "right", "copies")
    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_list(item).alias("wanted"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 21):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lists = batch.column(batch.schema.get_field_index("wanted"))
            flat = lists.flatten()
            count = np.array([len(x) for x in lists], np.int64)
            row = np.repeat(np.arange(len(texts)), count)
            field = {c: flat.field(c) for c in ("gram", "context", "pos", "left", "right", "copies")}
            pos, left, right = (field[c].to_numpy() for c in ("pos", "left", "right"))
            raw = [texts[r][a:b] for r, a, b in zip(row.tolist(), (pos - left).tolist(), (pos + right).tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [field["gram"], field["context"], *(batch.column(batch.schema.get_field_index(c)).take(take) for c in ("doc_id", "tag")),
                 field["pos"], field["left"], field["right"], field["copies"], pa.array(raw, pa.binary())],
                [c.split()[0] for c in CLASS.split(", ")],
            )

    rows = with_lists(named_bytes(docs), lists, "inner")
    # A repeated row gives its classes twice; they are equal.
    return rows.mapInArrow(lean(run), CLASS).dropDuplicates(["gram", "context"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also begins anywhere else, in the same text or another.

    One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (bytes, which may
    break a character) and ``kept_sha256``. All occurrences go, judged on the input. A null text is empty; shorter texts
    than ``length`` stay. Each row is a text of its own, also where rows or ids repeat. Other columns are ignored; an
    empty table gives an empty result.
    """
    spans = repeats(docs, length, groups=False, **options)
    return cut_spans(docs, spans.select("doc_id", "tag", "start", "end"))
