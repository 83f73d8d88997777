"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, one pass after the other. A packet of a
document ends at the virtual time "words of its source so far / target of its source". Sorting all
packets of all sources by that time interleaves them in proportion to the targets, wherever the mixture
is cut; it is cut where the total budget is used up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photofold.llm.common import pick_rows, row_tag, task_count
from photofold.session import cut_lineage

SEED = 20
PACKET_WORDS = 64
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Share ``budget`` by weight; what a source can't take (``most`` times its size) goes to the others."""
    out, free, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], float(budget)
    while free:
        per_weight = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * per_weight >= most * sizes[i]]
        for i in full or free:
            out[i] = float(most * sizes[i]) if full else weights[i] * per_weight
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in full] if full else []
    return out


def _running(parts: DataFrame, part: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of ``value`` over earlier partitions: a row for each partition and key."""
    sums = parts.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))


def _numbered(name: str, within: str | None, value: str) -> Callable:
    """Per partition, in its order: its number, the row's number and the sum of earlier values.

    The sum starts anew where ``within`` changes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, total, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            sums = np.cumsum(n)
            before = sums - n
            if within:
                key = batch.column(batch.schema.get_field_index(within)).to_numpy(zero_copy_only=False)
                new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
                first = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
                before = np.where(first >= 0, before - before[np.maximum(first, 0)], before + total)
                total, last = before[-1] + n[-1], key[-1]
            else:
                before = before + total
                total = before[-1] + n[-1]
            columns = [*batch.columns, pa.array(np.full(len(n), part)), pa.array(np.arange(row, row + len(n))), pa.array(before)]
            row += len(n)
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_row", name])

    return run


def source_targets(
    sized: DataFrame, weights: Sequence[float], share: float, most: float
) -> list[tuple[str | None, int, float]]:
    """(source, size, target), sources by code point and null last. One row per source is collected."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in rows]
    shares = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), most)
    return [(r.source, n, t) for r, n, t in zip(rows, sizes, shares)]


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = SEED,
    packet_words: int = PACKET_WORDS,
) -> DataFrame:
    """The mixture as packets in its global order.

    ``docs`` has ``doc_id``, ``source`` and ``size`` (words, not null), and may have a ``tag`` that tells rows of one
    id apart. Returns for each packet ``row_id`` (of its document), ``tag``, ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copy`` (0,
    1, ...), ``finish`` (virtual time), ``words``, ``position`` (increasing in the global order) and ``taken`` (all
    words, those up to the cut, or 0).

    Sources weigh ``weights`` in turn, by code point, null last, and share ``share`` times all words; none
    gets more than ``most`` times its own. Documents come in an order drawn by ``seed`` from their ids, so
    reruns agree. A document of no words is one packet of no words. Equal rows are interchangeable: they
    are told apart by their place in the order only. An empty table gives an empty result.

    Sources are few: a row for each is collected and sent along. A source of any size is cut into many
    partitions, since it is sorted by its shuffled order too.
    """
    spark = docs.sparkSession
    tag = F.col("tag") if "tag" in docs.columns else F.lit(0)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("size").cast("long").alias("size"), tag.cast("long").alias("tag")
    )
    known = source_targets(sized, weights, share, most)
    budget = int(round(sum(t for _, _, t in known)))
    schema = "source string, number int, source_size long, target double"
    plan = spark.createDataFrame([(s, i, n, t) for i, (s, n, t) in enumerate(known)], schema)
    plan = F.broadcast(plan.withColumnRenamed("source", "its"))
    tasks = task_count(docs)

    # 1. Each document's place in its queue.
    drawn = sized.join(plan, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    drawn = drawn.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    order = ["number", "draw", "doc_id", "size", "tag"]
    queued = drawn.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("draw")
    columns = "doc_id long, size long, tag long, number int, source_size long, target double"
    queued = cut_lineage(
        queued.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(
            _numbered("_inside", "number", "size"), f"{columns}, _part long, _row long, _inside long"
        )
    )
    starts = F.broadcast(_running(queued, "_part", "size", ["number"]))
    queued = queued.join(starts, ["number", "_part"])

    # 2. Packets of all passes with their virtual finish times.
    place = F.col("_before") + F.col("_inside")
    last = F.greatest(F.ceil(F.col("size") / packet_words).cast("long") - 1, F.lit(0))
    packets = (
        queued.select(
            F.shiftleft("_part", 33).bitwiseOR(F.col("_row")).alias("row_id"),
            "doc_id", "tag", "size", "number", "source_size", "target", place.alias("place"),
            F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"),
        )
        .withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("words", F.least(F.lit(packet_words).cast("long"), F.col("size") - F.col("packet") * packet_words))
    )
    done = F.col("copy") * F.col("source_size") + F.col("place") + F.col("packet") * packet_words + F.col("words")
    packets = packets.withColumn(
        "finish", F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(float("inf")))
    ).drop("place")

    # 3. Global order by finish time, cut at the budget.
    order = ["finish", "number", "row_id", "copy", "packet"]
    kinds = "row_id long, doc_id long, tag long, size long, number int, copy int, finish double, words long"
    names = [c.split()[0] for c in kinds.split(", ")]
    ordered = cut_lineage(
        packets.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .select(*names)
        .mapInArrow(_numbered("_inside", None, "words"), f"{kinds}, _part long, _row long, _inside long")
    )
    starts = F.broadcast(_running(ordered, "_part", "words"))
    left = F.lit(budget) - F.col("_before") - F.col("_inside")
    taken = F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long")
    return (
        ordered.join(starts, "_part")
        .join(plan, "number")
        .select(
            "row_id", "doc_id", "tag", F.col("its").alias("source"), "size", "source_size", "target", "copy", "finish",
            "words", F.shiftleft("_part", 33).bitwiseOR(F.col("_row")).alias("position"), taken.alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words, with
    repeats)."""
    packets = mix(docs, **options)
    return (
        packets.groupBy("row_id", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum("taken").alias("taken"))
        .drop("row_id")
    )


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """The mixture in whole documents: each row of ``docs`` as often as the mix takes half of it or more.

    ``docs`` has ``doc_id``, ``source`` and ``text``; all columns are kept. Documents of no words add nothing and go.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_tag(docs).alias("tag"))
    taken = (
        mix(sized, **options)
        .groupBy("row_id", "doc_id", "tag", "copy")
        .agg(F.sum("taken").alias("taken"), F.first("size").alias("size"))
        .withColumn("whole", ((F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size"))).cast("int"))
    )
    by_name = taken.groupBy("doc_id", "tag").agg(F.count_distinct("row_id").alias("rows"), F.sum("whole").alias("copies"))
    return pick_rows(docs, by_name.filter("copies > 0"))
