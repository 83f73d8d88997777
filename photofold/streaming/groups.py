"""Duplicate groups for assets that arrive over time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from photofold.config import SimilarityConfig
from photofold.operators.groups import best_shot
from photofold.operators.similarity import as_members, assign_roots, to_group
from photofold.plans.hot_keys import broadcast_if_fits, salted_join, top_n_per_key
from photofold.plans.ordering import BLOCK_ROWS
from photofold.schemas import library_keys
from photofold.session import child_folders, cut_lineage


@dataclass
class GroupStream:
    """Group assignment batch by batch, equal to one run over everything that was on time.

    Between batches only the last ``max_compare_count - 1`` assets of each library and
    their groups are kept; a batch reads those that the batch before it left. Assets at or before the newest one seen are late: they go to
    their own table and wait for a full run. Every batch writes its own folders, so a
    repeated batch replaces its output.
    """

    folder: str
    config: SimilarityConfig = field(default_factory=SimilarityConfig)
    block_rows: int = BLOCK_ROWS

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/{batch_id:012d}"

    def process(self, batch: DataFrame, batch_id: int) -> None:
        keys = library_keys(batch)
        stored = cut_lineage(batch)
        rows = to_group(stored)
        columns = [*keys, "asset_id", "taken_at", "_bits", "_root"]
        new = rows.withColumn("_root", F.lit(None).cast("string"))
        before = self._tails(batch, batch_id)
        if before is None:
            rows.drop("_bits").limit(0).write.mode("overwrite").parquet(self._path("late", batch_id))
        else:
            tail = self._present(before, rows, keys)
            new, late = self._split_late(new, tail, keys)
            late.drop("_root", "_bits").write.mode("overwrite").parquet(self._path("late", batch_id))
            new = new.select(*columns).unionByName(tail.select(*columns))
        roots = cut_lineage(assign_roots(new, self.config, self.block_rows))
        members = as_members(roots.filter("grouped"))
        members.write.mode("overwrite").parquet(self._path("members", batch_id))
        if {"width", "height", "blur_score", "mean_luma"} <= set(stored.columns):
            best = best_shot(members, stored)
            best.write.mode("overwrite").parquet(self._path("best", batch_id))
        n = max(self.config.max_compare_count - 1, 1)
        newest = [F.desc("taken_at"), F.desc("asset_id")]
        last = top_n_per_key(new, keys, newest, n).drop("_rank", "_root")
        ids = [*keys, "asset_id"]
        known = roots.select(*ids, F.col("root_id").alias("_root"))
        kept = known.join(broadcast_if_fits(last), ids)
        if before is not None and keys:  # libraries that this batch doesn't have go on as they are
            kept = kept.select(*columns).unionByName(self._present(before, rows, keys, "left_anti").select(*columns))
        kept.write.mode("overwrite").parquet(self._path("tail", batch_id))

    def _tails(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """The last assets of all libraries after the batch before."""
        known = [int(n) for n in child_folders(batch.sparkSession, f"{self.folder}/tail", "_SUCCESS")]
        newest = max((n for n in known if n < batch_id), default=None)
        return None if newest is None else batch.sparkSession.read.parquet(self._path("tail", newest))

    @staticmethod
    def _present(tails: DataFrame, rows: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
        """Those of the libraries in the batch, or not in it."""
        return tails.join(broadcast_if_fits(rows.select(*keys).distinct()), keys, how) if keys else tails

    @staticmethod
    def _split_late(new: DataFrame, tail: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        at = F.struct("taken_at", "asset_id")
        if keys:
            cursor = tail.groupBy(*keys).agg(F.max(at).alias("_cursor"))
            marked = salted_join(new, cursor, keys, "left")
            late = F.coalesce(at <= F.col("_cursor"), F.lit(False))
        else:
            last = tail.agg(F.max(at).alias("c")).first()["c"]
            if last is None:
                return new, new.limit(0)
            marked = new
            taken_at, asset_id = F.col("taken_at"), F.col("asset_id")
            late = (taken_at < last.taken_at) | (
                (taken_at == last.taken_at) & (asset_id <= last.asset_id)
            )
        marked = marked.withColumn("_late", late)
        extra = ["_late", "_cursor"]
        return marked.filter(~F.col("_late")).drop(*extra), marked.filter("_late").drop(*extra)

    def start(self, assets: DataFrame) -> DataStreamWriter:
        """Writer for a stream of catalog rows in rough time order, one row per asset."""
        return assets.writeStream.option(
            "checkpointLocation", f"{self.folder}/checkpoint"
        ).foreachBatch(self.process)

    def members(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/members/*")

    def best(self, spark) -> DataFrame:
        """Best shot of each group so far: the best of those that the batches found for their members."""
        rows = spark.read.parquet(f"{self.folder}/best/*")
        top = F.min(F.struct((-F.col("score")).alias("by"), "best_asset_id")).alias("top")
        keys = [*library_keys(rows), "group_id"]
        return rows.groupBy(*keys).agg(top).select(
            *keys, F.col("top.best_asset_id").alias("best_asset_id"), (-F.col("top.by")).alias("score")
        )

    def late(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late/*")
