"""Incremental scan: read new files, compute features, keep counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from photofold.config import DONE, ERROR
from photofold.operators.quality import image_features
from photofold.schemas import library_keys


def read_new_files(
    spark: SparkSession,
    path: str,
    schema: str,
    files_per_trigger: int | None = None,
    glob: str | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """Stream of a folder. Files per trigger is the batch size; the checkpoint is the cursor."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that is there, then stop; a later call resumes after it."""
    writer.trigger(availableNow=True).start().awaitTermination()


def scan_results(
    images: DataFrame, features_fn: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Features and status of each image; an unreadable one is an ERROR row, not a failure."""
    features = image_features(images, features_fn)
    return features.withColumn(
        "status", F.when(F.col("error_message").isNull(), DONE).otherwise(ERROR)
    )


def stream_ingest(images: DataFrame, folder: str) -> DataStreamWriter:
    """Append scan results of a stream of images; the file sink writes each batch once."""
    return (
        scan_results(images)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/results")
        .option("checkpointLocation", f"{folder}/checkpoint")
    )


@dataclass
class StatusStream:
    """Assets by their last status, so that a scan repeated counts once; batches come in time order."""

    folder: str

    def process(self, batch: DataFrame, batch_id: int) -> None:
        ids = [*library_keys(batch), "asset_id"]
        order = [c for c in ("updated_at",) if c in batch.columns] or ["status"]
        last = batch.groupBy(*ids).agg(F.max_by("status", F.struct(*order, "status")).alias("status"))
        path = f"{self.folder}/status/{batch_id:012d}"
        last.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(path)

    def start(self, results: DataFrame) -> DataStreamWriter:
        return results.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.process)

    def counts(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(f"{self.folder}/status/*")
        keys = library_keys(rows)
        last = rows.groupBy(*keys, "asset_id").agg(F.max_by("status", "_batch").alias("status"))
        return last.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("count"))


def on_time_assets(assets: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Each asset once, within a watermark on its time; ``delay`` is how late it may come."""
    keys = [*library_keys(assets), "asset_id"]
    timed = assets.withColumn("taken_time", F.timestamp_millis("taken_at"))
    return timed.withWatermark("taken_time", delay).dropDuplicatesWithinWatermark(keys)
