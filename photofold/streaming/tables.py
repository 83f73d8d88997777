"""Tables in buckets: a new version writes the buckets that changed and names where all of them lie."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photofold.session import child_folders, remove_folder

BUCKET = "_bucket"


def hash_bucket(columns: Sequence[str], buckets: int) -> Column:
    """The bucket of a row by a hash of its key."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("long")


def time_bucket(time: Column, bucket_ms: int) -> Column:
    return F.floor(time / bucket_ms).cast("long")


def buckets_of(rows: DataFrame, bucket: Column) -> list[int]:
    """The distinct buckets of the rows; a table has a bounded number of them."""
    return sorted(r[0] for r in rows.select(bucket.alias(BUCKET)).distinct().collect())


@dataclass
class BucketTable:
    """Versions of a table. Version ``v`` is ``versions/v``, which names for every bucket the version that wrote it, and a note;
    ``data/v`` holds the buckets that ``v`` wrote.

    The list of buckets is written last, so a version that was cut off is never read, and writing one again replaces it. ``order``
    sorts the rows of a bucket, which may be in many files.
    """

    folder: str
    schema: StructType
    order: Sequence[str] = ()

    def newest(self, spark: SparkSession, at_most: int | None = None) -> int | None:
        known = [int(n) for n in child_folders(spark, f"{self.folder}/versions", "_SUCCESS")]
        return max((n for n in known if at_most is None or n <= at_most), default=None)

    def _listed(self, spark: SparkSession, at_most: int | None) -> tuple[dict[int, int], int | None]:
        version = self.newest(spark, at_most)
        if version is None:
            return {}, None
        rows = spark.read.parquet(f"{self.folder}/versions/{version:012d}").collect()  # a row for each bucket
        note = next((r.note for r in rows if r.bucket is None), None)
        return {r.bucket: r.written for r in rows if r.bucket is not None}, note

    def note(self, spark: SparkSession, at_most: int | None = None) -> int | None:
        return self._listed(spark, at_most)[1]

    def buckets(self, spark: SparkSession, at_most: int | None = None) -> list[int]:
        return sorted(self._listed(spark, at_most)[0])

    def read(self, spark: SparkSession, buckets: Iterable[int] | None = None, at_most: int | None = None) -> DataFrame:
        """The rows of some buckets, or of all; no file of another bucket is opened."""
        listed = self._listed(spark, at_most)[0]
        wanted = listed if buckets is None else {b: listed[b] for b in buckets if b in listed}
        paths = [f"{self.folder}/data/{v:012d}/{BUCKET}={b}" for b, v in sorted(wanted.items())]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, bucket: Column, version: int, touched: Iterable[int] | None = None, note: int | None = None) -> None:
        """Replace the buckets ``touched`` (None: all) by ``rows``, which lie in these."""
        spark = rows.sparkSession
        known = {} if touched is None else self._listed(spark, version - 1)[0]
        path = f"{self.folder}/data/{version:012d}"
        names = [f.name for f in self.schema]
        laid = rows.select(*names, bucket.alias(BUCKET))
        key = [BUCKET, *(self.order or names[:1])]
        laid = laid.repartitionByRange(*key).sortWithinPartitions(*key)  # a large bucket is cut
        laid.write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        written = [int(n.split("=")[1]) for n in child_folders(spark, path) if n.startswith(f"{BUCKET}=")]
        gone = set(touched or ())
        entries = {b: v for b, v in known.items() if b not in gone} | dict.fromkeys(written, version)
        listed = spark.createDataFrame([(None, None, note), *((b, v, None) for b, v in entries.items())], "bucket bigint, written bigint, note bigint")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{version:012d}")

    def vacuum(self, spark: SparkSession) -> None:
        """Remove what the newest version doesn't use; nothing may be reading an earlier one."""
        version = self.newest(spark)
        used = {f"{v:012d}": {f"{BUCKET}={b}" for b, at in self._listed(spark, version)[0].items() if at == v} for v in range(version + 1)}
        for folder in child_folders(spark, f"{self.folder}/data"):
            for bucket in child_folders(spark, f"{self.folder}/data/{folder}"):
                if bucket.startswith(BUCKET) and bucket not in used.get(folder, ()):
                    remove_folder(spark, f"{self.folder}/data/{folder}/{bucket}")
        for folder in child_folders(spark, f"{self.folder}/versions"):
            if int(folder) < version:
                remove_folder(spark, f"{self.folder}/versions/{folder}")
