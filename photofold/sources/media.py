"""Media files and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_signature(mtime: Column | str, size: Column | str, exists: Column | None = None) -> Column:
    """``<mtime>_<size>``, 0 for a missing part, '' for what is not a readable file."""
    mtime = F.col(mtime) if isinstance(mtime, str) else mtime
    size = F.col(size) if isinstance(size, str) else size
    text = F.concat(
        F.coalesce(mtime.cast("string"), F.lit("0")),
        F.lit("_"),
        F.coalesce(size.cast("string"), F.lit("0")),
    )
    return text if exists is None else F.when(exists, text).otherwise(F.lit(""))


def read_media_files(
    spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True
) -> DataFrame:
    """Files as a listing with ``content``; select no content and none is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    seconds = F.unix_seconds("modificationTime")
    video = F.lower(F.col("path")).rlike(r"\.(mp4|mov|m4v|avi|mkv|webm)$")
    return files.select(
        F.col("path").alias("asset_id"),
        F.when(video, "video").otherwise("photo").alias("media_type"),
        F.unix_millis("modificationTime").alias("creation_time"),
        F.col("path").alias("uri"),
        F.col("path").alias("local_uri"),
        seconds.alias("mtime"),
        F.col("length").alias("size"),
        file_signature(seconds, F.col("length")).alias("file_signature"),
        "content",
    )


def write_report(report: DataFrame, path: str) -> None:
    """Write a report, one folder per library when there are several."""
    writer = report.write.mode("overwrite")
    if "library_id" in report.columns:
        writer = writer.partitionBy("library_id")
    writer.parquet(path)
