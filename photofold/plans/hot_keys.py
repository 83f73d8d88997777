"""Joins and top-n that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photofold.plans.ordering import POSITION, with_position
from photofold.session import cut_lineage

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; otherwise the plan keeps its shuffle join."""
    return F.broadcast(df) if fits(df, rows) else df


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    salt_by: Sequence[Column | str] = (),
) -> DataFrame:
    """Equi-join in which the left rows of a hot key are spread over many tasks.

    Keys with more than ``hot_rows`` left rows are split by a hash of the row (or of ``salt_by``); only
    their right rows are repeated. Counting the keys runs one job when the plan is built, for which ``left`` is
    evaluated once; the list of hot keys, which has a row per ``hot_rows`` rows at most, is stored.
    """
    on = list(on)
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = cut_lineage(counts.select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    hot = broadcast_if_fits(hot)
    named = [F.col(f"`{c}`") for c in left.columns]
    row_hash = F.xxhash64(*(salt_by or ([F.col("asset_id")] if "asset_id" in left.columns and "asset_id" not in on else named)))
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    spread = (
        F.when(F.col("_salts").isNotNull(), F.pmod(row_hash, F.col("_salts")))
        .when(null_key, F.pmod(row_hash, F.lit(4096)))
        .otherwise(F.lit(0))
        .cast("int")
    )
    left_salted = left.join(hot, on, "left").withColumn("_salt", spread).drop("_salts")
    copies = F.when(
        F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)
    ).otherwise(F.array(F.lit(0)))
    right_salted = (
        right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    )
    return left_salted.join(right_salted, [*on, "_salt"], how).drop("_salt")


def join_small(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table that is small as a rule: broadcast where its counted size allows, else split by hot keys."""
    if fits(right):
        return left.join(F.broadcast(right), list(on), how)
    return salted_join(left, right, on, how)


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int | None = None
) -> DataFrame:
    """The first ``n`` rows of every key, in two rounds so that a hot key is never one task.

    The first round is by key and input partition (or ``salts`` of a hash of the row), so it falls into pieces as the data grows, and for
    a large ``n`` too. Adds ``_rank`` (1…n).
    """
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    salted = df.withColumn("_salt", F.spark_partition_id() if salts is None else F.pmod(row_hash, F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= n)
        .drop("_salt")
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= n)
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None) -> DataFrame:
    """All rows in order, or the first ``n`` of each key (of the table where there are no keys)."""
    if n is None:
        return df.orderBy(*order)
    if not keys:
        return df.orderBy(*order).limit(n)
    return top_n_per_key(df, keys, order, n).drop("_rank").orderBy(*order)


def rank_in_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """``row_number()`` per key over the whole table, safe for hot keys.

    Number all rows in (key, order) and subtract the number of the key's first row.
    """
    numbered = with_position(df, [*keys, *order])
    starts = numbered.groupBy(*keys).agg(F.min(POSITION).alias("_start"))
    return (
        salted_join(numbered, starts, keys, salt_by=[POSITION])
        .withColumn(name, (F.col(POSITION) - F.col("_start") + 1).cast("int"))
        .drop(POSITION, "_start")
    )
