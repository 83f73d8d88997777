"""N-gram Jaccard join by MinHash banding.

1. Each document becomes its set of word 5-grams. Documents with one and the same set form a class, and go on
   as one.
2. A class has ``bands`` bands of ``rows`` minima each; classes that share a band are candidates. Bands and rows are
   chosen so that a pair at the threshold meets with probability ``recall``.
3. Candidates are grouped into connected groups. A large group is cut into blocks of some ``BLOCK`` classes, near ones
   together, and two blocks are compared if a band has classes in both: exact intersections of the full sets as matrix
   products, a small task for each pair of blocks. Only each class's number of links and its root within the two blocks leave
   the task, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photofold.llm.common import pick_rows, pieces, row_tag
from photofold.llm.spans import named_bytes
from photofold.llm.components import components
from photofold.llm.words import Words, lean, mix
from photofold.plans.ordering import with_running_total
from photofold.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 7
BLOCK = 128
#: A class of more shingles counts as several in a block.
SHINGLES = 1024
COLUMNS = 1 << 13


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The number of bands with which a pair at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, one of no words has none."""
    w = Words(texts)
    hashes = w.hashes() if len(w.start) else np.empty(0, np.uint64)
    at, windows = w.windows(hashes, words)
    edges = np.searchsorted(at, np.append(w.first, len(hashes)))
    out = []
    for k in range(len(texts)):
        own = windows[edges[k] : edges[k + 1]]
        if not len(own) and w.count[k]:
            total = np.full(1, int(w.count[k]), np.uint64)
            for h in hashes[w.first[k] : w.first[k] + w.count[k]]:
                total = mix(total * np.uint64(0x9FB21C651E98DF25) + h)
            own = total
        out.append(np.unique(own))
    return out


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    a = np.bitwise_xor.reduce(mix(own ^ np.uint64(0x1234567)))
    b = np.add.reduce(mix(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(own))))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def band_keys(own: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band, of the minima of ``rows`` hash functions of 32 bits."""
    k = np.arange(1, bands * rows + 1, dtype=np.uint64)
    factor = (mix(k) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    flip = (mix(k + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32)[:, None]
    short, least = (own >> np.uint64(32)).astype(np.uint32), None
    for x in range(0, len(short), 4096):
        part = ((short[x : x + 4096] ^ flip) * factor).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    minima = least.astype(np.uint64).reshape(bands, rows)
    total = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + minima[:, r])
    return total


def _sets(docs: DataFrame, words: int, bands: int, rows: int, tag: Column | None) -> DataFrame:
    """``doc_id``, ``tag``, ``h1``, ``h2`` (null for texts of no words), ``n`` shingles and the ``bands`` keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 19):
            keys, sizes, bands_ = [], [], []
            for own in shingle_sets([t or b"" for t in batch.column(2).to_pylist()], words):
                keys.append(set_key(own) if len(own) else (None, None))
                sizes.append(len(own))
                bands_.append(band_keys(own, bands, rows).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(bands_, pa.binary())],
                ["doc_id", "tag", "h1", "h2", "n", "bands"],
            )

    return named_bytes(docs, tag).mapInArrow(lean(run), "doc_id long, tag long, h1 long, h2 long, n long, bands binary")


def similar_in_blocks(
    left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sets with Jaccard similarity of ``threshold`` or more, some rows of ``left`` at a time.

    ``right`` None: pairs within ``left``, each once. Shingles that only one set has can't be shared and are left out.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    ok = shared[column]
    owner, column = owner[ok], place[column[ok]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, m, width = len(left), len(right) if right is not None else len(left), int(shared.sum())
    inter = np.zeros((n, m), np.float32)
    for first in range(0, width, COLUMNS):
        x, y = np.searchsorted(column, [first, first + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, width - first)), np.float32)
        dense[owner[x:y], column[x:y] - first] = 1
        inter += dense[:n] @ (dense[n:] if right is not None else dense).T
    other = sizes[n:] if right is not None else sizes
    union = sizes[:n, None] + other[None, :] - inter
    near = inter >= threshold * union - 1e-6 * union
    if right is None:
        near = np.triu(near, 1)
    yield np.nonzero(near)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each connected group."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float):
    """Links and roots of the classes in one pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        home, copies = table.column("home").to_numpy(), table.column("copies").to_numpy()
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        _, once = np.unique(node, return_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("own").take(pa.array(once)).to_pylist()]
        node, home, copies = node[once], home[once], copies[once]
        if first == second:
            index = np.arange(len(node))
            found = similar_in_blocks(sets, None, threshold)
            left = right = index
        else:
            left, right = np.flatnonzero(home == first), np.flatnonzero(home == second)
            found = similar_in_blocks([sets[i] for i in left], [sets[i] for i in right], threshold) if len(left) and len(right) else []
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for i, j in found:
            a, b = left[i], right[j]
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node)) if len(a) else np.zeros(len(node))
        root = node[_roots(len(node), a, b)]
        some = links > 0
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def deal(groups: DataFrame, classes: DataFrame, members: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """``node``, ``part``, its block ``home`` and the blocks it is compared with (``others``, its own among them).

    ``groups`` has the ``part`` of each node, ``members`` the nodes of each (band, key), ``edges`` leads from a node to the least of its
    (band, key). A group that fits into one block is one. Others are put in order of the least node that shares a band, so that
    nodes of one band come together, and cut; all (band, key) with nodes in the same blocks ask for the same pairs of blocks.
    """
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") / SHINGLES)).cast("long")
    weighed = groups.join(classes.select("node", weight.alias("weight")), "node")
    sizes = cut_lineage(weighed.groupBy("part").agg(F.sum("weight").alias("total")))  # stored, so that joins can split a large group
    few = groups.join(sizes.filter(F.col("total") <= block), "part").select("node", "part", F.lit(0).alias("home"), F.array(F.lit(0)).alias("others"))
    large = sizes.filter(F.col("total") > block).select("part")
    if large.isEmpty():
        return few
    near = edges.groupBy("u").agg(F.min("v").alias("near")).withColumnRenamed("u", "node")
    crowded = weighed.join(large, "part").join(near, "node", "left").withColumn("near", F.least("near", "node"))
    ordered = with_running_total(crowded, ["part", "near", "node"], "upto", F.col("weight"))
    ordered = cut_lineage(ordered.withColumn("before", F.col("upto") - F.col("weight")).select("node", "part", "before"))
    starts = cut_lineage(ordered.groupBy("part").agg(F.min("before").alias("start")))
    homes = cut_lineage(ordered.join(starts, "part").select("node", "part", F.floor((F.col("before") - F.col("start")) / block).cast("int").alias("home")))
    # A (band, key) is named by the blocks it is in, of which there are few beside its nodes.
    spread = members.join(homes, "node").groupBy("part", "band", "key").agg(F.sort_array(F.collect_set("home")).alias("homes"))
    asked = spread.select("part", "homes").distinct().withColumn("first", F.explode("homes"))
    asked = asked.select("part", "first", F.explode(F.filter("homes", lambda x: x >= F.col("first"))).alias("second")).distinct()
    both = asked.union(asked.select("part", F.col("second").alias("first"), F.col("first").alias("second")))
    partners = cut_lineage(both.groupBy("part", F.col("first").alias("home")).agg(F.collect_set("second").alias("others")))
    return few.union(homes.join(partners, ["part", "home"]).select("node", "part", "home", "others"))


def similar_documents(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    rows: int = ROWS,
    block: int = BLOCK,
    tag: Column | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id``, ``n_links`` ``class_number`` (unique, null for texts of no words)
    and ``tag`` (by default a hash of the text).

    Two documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of ``threshold`` or
    more; ``n_links`` counts the other rows linked to this one, copies too. ``class_id`` is the least id of all rows
    that links connect. Words end at ASCII white space and are compared as they stand. A text of fewer words is one
    shingle; a null or empty text is linked to nothing, and its class is its own id. Null ids come last in a
    class: its id is null only if all are. Rows with the same id stay rows of their own. Other columns are ignored;
    an empty table gives an empty result.

    A pair at the threshold is found with probability ``recall``, nearer ones more surely. No candidate is dropped: a
    group of any size is compared block by block, wherever two blocks share a band.
    """
    bands = bands_for(threshold, recall, rows)
    sets = cut_lineage(_sets(docs, words, bands, rows, tag))
    classes = sets.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("one"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n").alias("n")
    )
    classes = classes.select("h1", "h2", F.col("one.doc_id").alias("least"), F.col("one.tag").alias("least_tag"), "copies", "bands", "n")
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))

    # Candidates: classes that share a band, grouped.
    keyed = classes.select("node", F.posexplode(_longs("bands", bands)).alias("band", "key"))
    met = keyed.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    met = cut_lineage(met)
    edges = keyed.join(met, ["band", "key"]).filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
    edges = cut_lineage(edges)
    groups = cut_lineage(components(edges).withColumnRenamed("label", "part"))
    dealt = deal(groups, classes, keyed.join(met, ["band", "key"]).select("band", "key", "node"), edges, block)
    wanted = dealt.join(classes.select("node", "h1", "h2", "least", "least_tag", "copies"), "node")

    # Full sets of one document of each candidate class, named by id and tag: many rows may have no id.
    on = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("tag") == F.col("least_tag"))
    located = named_bytes(docs, tag).join(wanted, on).drop("least", "least_tag", "doc_id", "tag")

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 19):
            own = shingle_sets([t or b"" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], words)
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h1", "h2")))
            same = [len(x) > 0 and set_key(x) == k for x, k in zip(own, keys)]  # another row with this id may differ
            keep = pa.array(np.flatnonzero(same))
            names = ["node", "part", "home", "others", "copies"]
            columns = [batch.column(batch.schema.get_field_index(c)).take(keep) for c in names]
            raw = pa.array([x.tobytes() for x, s in zip(own, same) if s], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, raw], [*names, "own"])

    loaded = located.mapInArrow(lean(full), "node long, part long, home int, others array<int>, copies long, own binary")
    pairs = loaded.withColumn("other", F.explode("others")).select(
        "part", F.least("home", "other").alias("first"), F.greatest("home", "other").alias("second"), "node", "home", "copies", "own"
    )
    compared = pairs.groupBy("part", "first", "second").applyInArrow(_compare(threshold), "node long, links long, root long")
    compared = cut_lineage(compared)
    final = components(compared.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))

    counted = classes.join(links, "node", "left").join(final, "node", "left").select(
        "h1", "h2", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", F.col("node")).alias("label")
    )
    counted = cut_lineage(counted)
    names = cut_lineage(counted.groupBy("label").agg(F.min("least").alias("class_id")))  # stored, so that the join can split a large class
    by_set = counted.join(names, "label").select(
        "h1", "h2", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("label").alias("class_number")
    )
    left = sets.select("doc_id", "tag", "h1", "h2")
    out = left.filter("h1 is not null").join(by_set, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "class_number", "tag")
    alone = left.filter("h1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long"), "tag")
    return out.union(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are left when one document of each class stays, the one with the least id.

    Null ids come last, and of equal rows one stays. Texts of no words are in no class, so all of them stay. All columns
    are kept.
    """
    found = similar_documents(docs, tag=row_tag(docs), **options)
    names = found.groupBy("class_number", "doc_id", "tag").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "rows")).alias("first")
    stay = names.filter("class_number is not null").groupBy("class_number").agg(first)
    alone = names.filter("class_number is null").select("doc_id", "tag", F.lit(1).alias("rows"), F.lit(1).alias("copies"))
    return pick_rows(docs, stay.select("first.doc_id", "first.tag", "first.rows", F.lit(1).alias("copies")).union(alone))


def _longs(column: str, count: int):
    """The ``count`` 8-byte pieces of a binary column, as hash keys."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.xxhash64(F.substring(F.col(column), k * 8 + 1, F.lit(8))))
