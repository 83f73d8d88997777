"""Line dedup over levelled sorted runs of line hashes.

A run is a sorted Parquet table of ``(key, n_docs, last_doc)``: a line's digest, the number of
documents that hold the line and the largest id among them. Each batch of documents is anti-joined with the runs,
by sort-merge joins on the digest, and adds what they don't hold as a run of level 0; what they do hold is counted in a run
beside them. When a level holds ``fanout`` runs they are merged into one run of the next level, so
that after n batches a look-up meets O(log n) runs and each entry has been rewritten O(log n)
times. Nothing is collected, and a line that stands in every document is one row per task before the shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photofold.llm.common import SPACES
from photofold.plans.hot_keys import broadcast_if_fits
from photofold.session import cut_lineage, run_folder, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN_SCHEMA = "key binary, n_docs long, last_doc long"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case and nothing else changed."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digests(text: Column, min_chars: int) -> Column:
    """Per line of the text its digest as hex, or null where its key is too short to count."""
    keys = F.transform(lines_of(text), line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.md5(k)))


class LineRuns:
    """The levelled runs in one folder.

    Compaction never changes a run that is being read: it writes the merged run first and only
    then forgets its sources.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, min_chars: int = 40, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.min_chars, self.fanout = spark, min_chars, fanout
        self.folder = folder or run_folder(spark, "line-runs")
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.counts: dict[int, list[str]] = defaultdict(list)
        self._written = 0

    def entries(self, docs: DataFrame) -> DataFrame:
        """One row per line and document, without regard to repeats inside the document."""
        distinct = F.array_distinct(F.array_compact(digests(F.col("text"), self.min_chars)))
        return docs.select("doc_id", F.explode(distinct).alias("hex")).select(
            F.unhex("hex").alias("key"), F.col("doc_id").cast("long").alias("doc_id")
        )

    def add(self, docs: DataFrame) -> None:
        """Anti-join a batch with the runs, add what is new as a run of level 0, and compact the levels that are full.

        Keys that a run holds already are counted in a run of their own, which is compacted likewise.
        """
        new, remove = stored(
            self.entries(docs).groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        )
        if not self.paths():
            self._add("keys", new)
        else:
            fresh, remove_fresh = stored(self._not_held(new))
            self._add("counts", new.join(fresh.select("key"), "key", "left_anti"))
            self._add("keys", fresh)
            remove_fresh()
        remove()

    def _add(self, kind: str, rows: DataFrame) -> None:
        levels = self.levels if kind == "keys" else self.counts
        self._write(kind, levels, 0, rows)
        level = 0
        while len(levels[level]) >= self.fanout:
            sources = levels[level]
            merged = reduce(DataFrame.unionByName, [self._read(p) for p in sources])
            # No key is in two runs of keys; counts of one key are added up.
            self._write(kind, levels, level + 1, merged if kind == "keys" else self._summed(merged))
            levels[level] = [p for p in levels[level] if p not in sources]
            level += 1

    def _not_held(self, rows: DataFrame) -> DataFrame:
        """The rows whose key no run holds: a merge anti-join with each run."""
        for path in self.paths():
            rows = rows.join(self._read(path).select("key").hint("merge"), "key", "left_anti")
        return rows

    def unseen(self, docs: DataFrame) -> DataFrame:
        """The batch's (key, doc_id) rows whose key no run holds."""
        return self._not_held(self.entries(docs))

    def merged(self) -> DataFrame:
        """All runs as one: no key twice."""
        keys, counts = self.paths(), self.paths(self.counts)
        if not keys:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        rows = reduce(DataFrame.unionByName, [self._read(p) for p in keys + counts])
        return self._summed(rows) if counts else rows

    def paths(self, levels: dict[int, list[str]] | None = None) -> list[str]:
        levels = self.levels if levels is None else levels
        return [p for level in sorted(levels) for p in levels[level]]

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(path)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _write(self, kind: str, levels: dict[int, list[str]], level: int, rows: DataFrame) -> None:
        path = f"{self.folder}/{kind}-{level}/run-{self._written}"
        self._written += 1
        rows.sortWithinPartitions("key").write.parquet(path)
        levels[level].append(path)


def batches_of_files(docs: DataFrame, most: int = 4) -> list[DataFrame]:
    """The table in at most ``most`` batches: of whole files, or by a hash of the id where it has a single one."""
    files = sorted(docs.inputFiles())
    if len(files) < 2:
        return [docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(most)) == k) for k in range(most)]
    size = -(-len(files) // most)
    read = docs.sparkSession.read.schema(docs.schema)
    return [read.parquet(*files[i : i + size]) for i in range(0, len(files), size)]


def dedup_lines(
    docs: DataFrame,
    batches: Iterable[DataFrame] | None = None,
    min_chars: int = 40,
    min_docs: int = 5,
    fanout: int = 4,
) -> DataFrame:
    """Drop lines held by ``min_docs`` documents or more, except in the one with the largest id.

    Returns one row per input row: ``doc_id``, ``n_lines`` before dropping, ``n_dropped`` and the
    remaining ``text``. ``batches`` are the same rows in the parts in which they arrive (default:
    all at once); the result does not depend on them. All copies of a kept line within its
    document stay.

    A null or empty text has one empty line. Each row counts as one document, also where rows or
    ids repeat; rows that share the largest id all keep the line. A null id is smaller than every
    other; if only documents without an id hold a line, all of them keep it. Other columns are
    ignored. An empty table gives an empty result. Runs stay in the session's shared folder.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = LineRuns(docs.sparkSession, min_chars=min_chars, fanout=fanout)
    for batch in [docs] if batches is None else batches:
        runs.add(batch)
    # Stored, so that Spark can split the join where every document holds a line.
    frequent = cut_lineage(runs.merged().filter(F.col("n_docs") >= min_docs).select("key", "last_doc"))

    # What goes from a row depends on its id and text alone, so these name the row.
    name = {
        "doc": F.col("doc_id"),
        "h1": F.xxhash64("text"),
        "h2": F.xxhash64(F.lit(1), F.col("text")),
    }
    lines = docs.select(
        *[e.alias(n) for n, e in name.items()], F.posexplode(digests(F.col("text"), min_chars)).alias("at", "hex")
    ).filter("hex is not null")
    repeated = lines.withColumn("key", F.unhex("hex")).join(broadcast_if_fits(frequent), "key")
    gone = (
        repeated.filter(~F.col("doc").eqNullSafe(F.col("last_doc")))
        .groupBy(*name)
        .agg(F.sort_array(F.collect_set("at")).alias("gone"))
    )
    # Flags by position: false up to each line that goes, so that every look-up is by index.
    flags = F.flatten(
        F.transform(
            "gone",
            lambda x, i: F.concat(
                F.array_repeat(
                    F.lit(False), x - F.coalesce(F.when(i > 0, F.get(F.col("gone"), i - 1)), F.lit(-1)) - 1
                ),
                F.array(F.lit(True)),
            ),
        )
    )
    g, d = gone.withColumn("flags", flags).alias("g"), docs.select("doc_id", "text", *[e.alias(n) for n, e in name.items()]).alias("d")
    joined = d.join(
        g,
        F.col("d.doc").eqNullSafe(F.col("g.doc")) & (F.col("d.h1") == F.col("g.h1")) & (F.col("d.h2") == F.col("g.h2")),
        "left",
    ).select("doc_id", "text", "gone", "flags")
    kept = F.filter(lines_of(F.col("text")), lambda line, i: ~F.coalesce(F.get(F.col("flags"), i), F.lit(False)))
    return joined.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
