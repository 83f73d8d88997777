"""Global row order without a single-task window.

Spark's range exchange splits rows evenly by the sort key, also inside one hot
library or one hot millisecond as long as the key ends in a unique column. Rows
are numbered from the per-partition counts, so no task ever sees more than one
range. Fixed-size blocks of consecutive numbers then serve look-back windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photofold.session import cut_lineage

POSITION = "_position"
PART = "_part"
ROW_IN_PART = "_row_in_part"
BLOCK = "_block"
HOME = "_home"
BLOCK_ROWS = 4_000  # with its visitors under the row count Spark's windows keep as plain objects

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a small input has fewer partitions than that; else no change."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sorted_parts(
    df: DataFrame, order: Sequence[Column | str], store: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """Sort globally and store the result with each row's partition and row number.

    The sort is written out because range bounds are sampled: a plan that sorted
    twice could cut the data at different places.
    """
    ordered = store(df.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()))
    return ordered.withColumns(
        {
            PART: F.shiftright("_rid", _ROW_BITS).cast("int"),
            ROW_IN_PART: F.col("_rid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_rid")


def before_part(parts: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Sums over all earlier partitions: one row per shuffle partition, so broadcast-safe."""
    per_part = parts.groupBy(PART).agg(*[expr.alias(name) for name, expr in totals.items()])
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        PART, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals]
    )


def with_position(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Add ``_position``: 0, 1, 2, … in the global order."""
    parts = sorted_parts(df, order)
    starts = before_part(parts, {"_start": F.count(F.lit(1))})
    return (
        parts.join(F.broadcast(starts), PART)
        .withColumn(POSITION, F.col("_start") + F.col(ROW_IN_PART))
        .drop(PART, ROW_IN_PART, "_start")
    )


def number_sorted(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in the order of a frame that is sorted already, by an ``orderBy`` at its end."""
    parts = cut_lineage(df.withColumn("_rid", F.monotonically_increasing_id()))
    part = F.shiftright("_rid", _ROW_BITS).cast("int")
    inside = F.col("_rid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    parts = parts.withColumns({PART: part, ROW_IN_PART: inside}).drop("_rid")
    starts = before_part(parts, {"_start": F.count(F.lit(1))})
    numbered = parts.join(F.broadcast(starts), PART)
    return numbered.withColumn(name, F.col("_start") + F.col(ROW_IN_PART) + 1).drop(PART, ROW_IN_PART, "_start")


def with_running_total(
    df: DataFrame, order: Sequence[Column | str], name: str, value: Column
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to and including this one."""
    parts = sorted_parts(df.withColumn("_value", value.cast("long")), order)
    starts = before_part(parts, {"_start": F.sum("_value")})
    inside = (
        Window.partitionBy(PART)
        .orderBy(ROW_IN_PART)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        parts.withColumn("_inside", F.sum("_value").over(inside))
        .join(F.broadcast(starts), PART)
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop(PART, ROW_IN_PART, "_value", "_inside", "_start")
    )


def in_blocks(positioned: DataFrame, look_back: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Assign rows to equal blocks; the last ``look_back`` rows also visit the next block.

    ``_home`` is false on those visitors: drop them once the window is computed.
    """
    if look_back > block_rows:
        raise ValueError("look_back must fit in one block")
    own = F.floor(F.col(POSITION) / block_rows)
    near_end = F.col(POSITION) % block_rows >= block_rows - look_back
    return positioned.withColumn(
        BLOCK, F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    ).withColumn(HOME, F.col(BLOCK) == own)


def block_window():
    """Window over one block in global order."""
    return Window.partitionBy(BLOCK).orderBy(POSITION)
