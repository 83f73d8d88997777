"""A catalog laid out for reading by time: a folder for each library and month, sorted by time and id inside.

A read with a time range opens the folders of its months, and in them the row groups whose times fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photofold.schemas import library_keys

MONTH = "taken_month"
#: The folder of assets without a time.
NO_MONTH = -1


def month_of(taken_at: Column) -> Column:
    """Months since year 0, by UTC."""
    day = F.date_from_unix_date(F.floor(taken_at / 86_400_000).cast("int"))
    return F.coalesce(F.year(day) * 12 + F.month(day) - 1, F.lit(NO_MONTH))


def write_clustered(catalog: DataFrame, path: str) -> None:
    """Write the whole catalog. Large months are cut into several files, each a range of times."""
    keys = [*library_keys(catalog), MONTH, "taken_at", "asset_id"]
    laid = catalog.withColumn(MONTH, month_of(F.col("taken_at"))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid.write.mode("overwrite").partitionBy(*library_keys(catalog), MONTH).parquet(path)


def read_clustered(spark: SparkSession, path: str, since: int | None = None, until: int | None = None, library: str | None = None) -> DataFrame:
    """The catalog, or its assets with ``since <= taken_at <= until``, of one library."""
    rows = spark.read.parquet(path)
    for bound, compare in ((since, "__ge__"), (until, "__le__")):
        if bound is not None:
            limit = F.lit(bound).cast("bigint")
            rows = rows.filter(getattr(F.col(MONTH), compare)(month_of(limit)) & getattr(F.col("taken_at"), compare)(limit))
    if library is not None:
        rows = rows.filter(F.col("library_id") == library)
    return rows.drop(MONTH)
