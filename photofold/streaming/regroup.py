"""Duplicate groups that are mended where assets arrive late, change or go.

A link never crosses a gap longer than the time window, so the time line of a library falls apart into islands, and a change
touches the islands that hold its old and its new place alone. Grouped assets are stored in buckets of time, each row with the
extent of its island; places of assets in buckets of their ids. A batch of changes reads the buckets of the ids it names, the buckets
of time around them and those that their islands reach into, groups the islands hit anew, and writes the buckets of these.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from photofold.config import SimilarityConfig
from photofold.operators.similarity import as_members, assign_roots, to_group
from photofold.plans.hot_keys import join_small, salted_join
from photofold.plans.ordering import BLOCK_ROWS, PART, ROW_IN_PART, before_part, sorted_parts
from photofold.schemas import LIBRARY, library_keys
from photofold.session import cut_lineage
from photofold.streaming.tables import BucketTable, buckets_of, hash_bucket, time_bucket

ISLAND = "_island"


def with_islands(rows: DataFrame, window_ms: int) -> DataFrame:
    """Add ``_island``: the number of the stretch of ``taken_at`` without a gap longer than the window, in one library."""
    keys = library_keys(rows)
    parts = sorted_parts(rows, [*keys, "taken_at", "asset_id"])
    here = F.struct(*keys, "taken_at")
    ends = parts.groupBy(PART).agg(F.max_by(here, ROW_IN_PART).alias("_end"))
    before = ends.select(PART, F.lag("_end").over(Window.orderBy(PART)).alias("_end"))  # a row for each partition
    in_part = Window.partitionBy(PART).orderBy(ROW_IN_PART)
    back = F.coalesce(F.lag(here).over(in_part), F.col("_end"))
    linked = parts.join(F.broadcast(before), PART).withColumn("_back", back)
    same = F.col("taken_at") - F.col("_back.taken_at") <= window_ms
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_back.{key}"))
    new = (~F.coalesce(F.col("_back").isNotNull() & same, F.lit(False))).cast("long")
    flagged = linked.withColumn("_new", new).drop("_back", "_end")
    starts = before_part(flagged, {"_start": F.sum("_new")})
    inside = F.sum("_new").over(in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = flagged.withColumn("_inside", inside).join(F.broadcast(starts), PART)
    return numbered.withColumn(ISLAND, F.col("_start") + F.col("_inside")).drop(PART, ROW_IN_PART, "_new", "_start", "_inside")


@dataclass
class GroupTable:
    """Groups of all processed assets, equal after every batch to one run over the catalog as it then is.

    ``libraries`` tells whether rows have a ``library_id``. Version 0 is the first run; batch ``k`` makes version ``k + 1`` from what was
    before it, so a repeated batch replaces its output.
    """

    folder: str
    config: SimilarityConfig = field(default_factory=SimilarityConfig)
    libraries: bool = False
    bucket_ms: int = 86_400_000
    id_buckets: int = 64
    block_rows: int = BLOCK_ROWS

    def __post_init__(self) -> None:
        self._keys = [LIBRARY] if self.libraries else []
        self._ids = [*self._keys, "asset_id"]
        kinds = "".join(f"{k} string, " for k in self._keys)
        columns = f"{kinds}asset_id string, taken_at bigint, _bits bigint, root_id string, distance_to_parent int, _first bigint, _last bigint"
        self.rows = BucketTable(f"{self.folder}/rows", StructType.fromDDL(columns), [*self._keys, "taken_at", "asset_id"])
        self.places = BucketTable(f"{self.folder}/places", StructType.fromDDL(f"{kinds}asset_id string, taken_at bigint"), self._ids)

    def _time(self, column: str = "taken_at") -> Column:
        return time_bucket(F.col(column), self.bucket_ms)

    def _id(self) -> Column:
        return hash_bucket(self._ids, self.id_buckets)

    def first_run(self, assets: DataFrame) -> None:
        """Group a whole catalog."""
        marked = self._marked(to_group(assets))
        extents = marked.groupBy(ISLAND).agg(F.min("taken_at").alias("_first"), F.max("taken_at").alias("_last"))
        spanned = salted_join(marked, extents, [ISLAND]).drop(ISLAND)
        self._store(self._grouped(spanned), 0, None, None)

    def _marked(self, rows: DataFrame) -> DataFrame:
        return cut_lineage(with_islands(rows, self.config.window_ms))

    def _grouped(self, rows: DataFrame) -> DataFrame:
        """Rows (``taken_at``, ``_bits``, extents) with their roots."""
        alone = rows.select(*self._ids, "taken_at", "_bits", F.lit(None).cast("string").alias("_root"))
        roots = assign_roots(alone, self.config, self.block_rows).select(*self._ids, "root_id", "distance_to_parent")
        return cut_lineage(rows.join(roots, self._ids))

    def _store(self, rows: DataFrame, version: int, touched: list[int] | None, touched_ids: list[int] | None, places: DataFrame | None = None) -> None:
        self.places.write(rows if places is None else places, self._id(), version, touched_ids)
        self.rows.write(rows, self._time(), version, touched)  # last: what makes the version count

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Catalog rows as they are now, one for each changed asset; those that are not DONE or have no time leave their group.

        ``changes/<batch>`` then lists what members are retracted and added.
        """
        spark, before, window = changes.sparkSession, batch_id, self.config.window_ms
        named = cut_lineage(changes.select(*self._ids, "taken_at", "phash", "status"))
        new = to_group(named)
        ids = buckets_of(named, self._id())
        places = self.places.read(spark, ids, before)
        old = join_small(places, named.select(*self._ids), self._ids)
        points = old.select("taken_at").union(new.select("taken_at"))
        around = F.sequence(time_bucket(F.col("taken_at") - window, self.bucket_ms), time_bucket(F.col("taken_at") + window, self.bucket_ms))
        near = buckets_of(points.select(F.explode(around).alias("b")), F.col("b"))
        reach = F.explode(F.sequence(self._time("_first"), self._time("_last")))
        further = buckets_of(self.rows.read(spark, near, before).select(reach.alias("b")), F.col("b"))
        read = sorted({*near, *further})

        # The islands of old and new rows together, and which of them a change touches.
        stored = self.rows.read(spark, read, before).withColumn("_old", F.lit(True))
        changed = join_small(stored, named.select(*self._ids, F.lit(True).alias("_hit")), self._ids, "left")
        fresh = new.withColumns({"_old": F.lit(False), "_hit": F.lit(True)})
        kept = ["taken_at", "_bits", "root_id", "distance_to_parent", "_old", "_hit"]
        both = changed.drop("_first", "_last").unionByName(fresh, allowMissingColumns=True).select(*self._ids, *kept)
        marked = self._marked(both)
        extents = marked.groupBy(ISLAND).agg(F.min("taken_at").alias("_first"), F.max("taken_at").alias("_last"), F.max(F.coalesce("_hit", F.lit(False))).alias("_touched"))
        spanned = cut_lineage(salted_join(marked, extents, [ISLAND]).drop(ISLAND))
        hit = spanned.filter("_touched")
        after = self._grouped(hit.filter("NOT _old OR _hit IS NULL").select(*self._ids, "taken_at", "_bits", "_first", "_last"))
        was = hit.filter("_old").select(*self._ids, "taken_at", "_bits", "root_id", "distance_to_parent")

        written = buckets_of(hit, self._time())
        aside = spanned.filter(~F.col("_touched")).filter(self._time().isin(written))  # other islands of these buckets stay as they are
        rows = after.unionByName(aside.select(after.columns))
        gone = join_small(places, named.select(*self._ids, F.lit(True).alias("_named")), self._ids, "left").filter("_named IS NULL").drop("_named")
        self._log(was, after, batch_id)
        self._store(rows, batch_id + 1, written, ids, gone.unionByName(new.select(*self._ids, "taken_at")))

    def _log(self, was: DataFrame, now: DataFrame, batch_id: int) -> None:
        def listed(rows: DataFrame, name: str) -> DataFrame:
            return rows.filter("_bits IS NOT NULL").select(*self._ids, F.struct("root_id", "distance_to_parent").alias(name))

        pairs = listed(was, "_was").join(listed(now, "_now"), self._ids, "full").filter(~F.col("_was").eqNullSafe(F.col("_now")))
        step = F.explode(F.array_compact(F.array(
            F.when(F.col("_was").isNotNull(), F.struct(F.lit("retract").alias("op"), F.col("_was").alias("m"))),
            F.when(F.col("_now").isNotNull(), F.struct(F.lit("add").alias("op"), F.col("_now").alias("m"))),
        )))
        flat = pairs.select(*self._ids, step.alias("s")).select(*self._ids, "s.op", "s.m.root_id", "s.m.distance_to_parent")
        flat.write.mode("overwrite").parquet(f"{self.folder}/changes/{batch_id:012d}")

    def start(self, changes: DataFrame) -> DataStreamWriter:
        """Writer for a stream of changed catalog rows."""
        return changes.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.apply)

    def members(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """Group of every processed asset with a time and a hash."""
        return as_members(self.rows.read(spark, at_most=version).filter("_bits IS NOT NULL"))

    def changes(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Members that a batch retracted and added: ``op``, the asset, its root and the distance to its parent."""
        return spark.read.parquet(f"{self.folder}/changes/{batch_id:012d}")
