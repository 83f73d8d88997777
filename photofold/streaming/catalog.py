"""A catalog kept as base table plus a log of partial updates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from photofold.operators.catalog import upsert_coalesce
from photofold.schemas import LIBRARY
from photofold.streaming.tables import BucketTable, buckets_of, hash_bucket


def stream_upsert(updates: DataFrame, folder: str) -> DataStreamWriter:
    """Append updates to the log; no catalog row is rewritten while streaming."""
    return (
        updates.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/log")
        .option("checkpointLocation", f"{folder}/checkpoint")
    )


def current_catalog(
    base: DataFrame, log: DataFrame, seq: str = "seq", now: Column | None = None
) -> DataFrame:
    """The catalog as of the log: last non-NULL value of each field over the base."""
    return upsert_coalesce(base, log, seq, now)


@dataclass
class CompactedCatalog:
    """Versions of the base table, each with the highest ``seq`` that was folded into it.

    Updates up to that number are skipped when the log is folded again, so they can't undo what came later. A
    compaction writes a new version and leaves the ones before it alone.
    """

    folder: str
    seq: str = "seq"

    def start(self, base: DataFrame) -> None:
        self._write(base, 0, None)

    def current(self, spark: SparkSession, log: DataFrame, now: Column | None = None) -> DataFrame:
        version = self._newest(spark)
        return current_catalog(self._base(spark, version["version"]), self._newer(log, version), self.seq, now)

    def compact(self, spark: SparkSession, log: DataFrame, now: Column | None = None) -> None:
        version = self._newest(spark)
        newer = self._newer(log, version)
        folded = newer.agg(F.max(self.seq).alias("seq")).first()["seq"]
        if folded is not None:
            # What arrives meanwhile has a higher number and waits for the next compaction.
            fixed = newer.filter(F.col(self.seq) <= folded)
            base = self._base(spark, version["version"])
            self._write(current_catalog(base, fixed, self.seq, now), version["version"] + 1, folded)

    def _newer(self, log: DataFrame, version) -> DataFrame:
        return log if version["folded"] is None else log.filter(F.col(self.seq) > version["folded"])

    def _base(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/base/{version:06d}")

    def _write(self, base: DataFrame, version: int, folded: int | None) -> None:
        """The entry in the list of versions is written last, so a half-written base is never read."""
        base.write.mode("overwrite").parquet(f"{self.folder}/base/{version:06d}")
        spark = base.sparkSession
        row = spark.createDataFrame([(version, folded)], "version int, folded bigint")
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")

    def _newest(self, spark: SparkSession):
        return spark.read.parquet(f"{self.folder}/versions").orderBy(F.desc("version")).first()


@dataclass
class BucketedCatalog:
    """The same with a base in buckets by a hash of the asset's key: a compaction reads and writes the buckets that the log names.

    Versions are kept until ``vacuum``; each notes the highest ``seq`` that it holds.
    """

    folder: str
    schema: StructType
    buckets: int = 256
    seq: str = "seq"

    @cached_property
    def table(self) -> BucketTable:
        return BucketTable(f"{self.folder}/base", self.schema, self._keys)

    @property
    def _keys(self) -> list[str]:
        return [LIBRARY, "asset_id"] if LIBRARY in self.schema.names else ["asset_id"]

    def _bucket(self) -> Column:
        return hash_bucket(self._keys, self.buckets)

    def start(self, base: DataFrame) -> None:
        self.table.write(base, self._bucket(), 0)

    def _newer(self, spark: SparkSession, log: DataFrame) -> DataFrame:
        folded = self.table.note(spark)
        return log if folded is None else log.filter(F.col(self.seq) > folded)

    def current(self, spark: SparkSession, log: DataFrame, now: Column | None = None) -> DataFrame:
        return current_catalog(self.table.read(spark), self._newer(spark, log), self.seq, now)

    def compact(self, spark: SparkSession, log: DataFrame, now: Column | None = None) -> list[int]:
        """Fold what the log has beyond the base; returns the buckets written."""
        newer = self._newer(spark, log)
        folded = newer.agg(F.max(self.seq).alias("seq")).first()["seq"]
        if folded is None:
            return []
        fixed = newer.filter(F.col(self.seq) <= folded)
        touched = buckets_of(fixed, self._bucket())
        rows = current_catalog(self.table.read(spark, touched), fixed, self.seq, now)
        self.table.write(rows, self._bucket(), self.table.newest(spark) + 1, touched, folded)
        return touched
