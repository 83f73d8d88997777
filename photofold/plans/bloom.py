"""A Bloom filter as a small table: rows that can't be among some keys are left out before dear work is done on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Keys of one block of eight 64-bit words: about one in two hundred other keys passes.
KEYS_IN_BLOCK = 32
#: The table is broadcast, so it has a bound: a million blocks of 64 bytes.
MOST_BLOCKS = 1 << 20

_BLOCK = "_bloom_block"


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(blocks))


def _bit(keys: Sequence[str], word: int) -> Column:
    """The bit that a key has in a word of its block."""
    place = F.pmod(F.xxhash64(F.lit(word + 1), *keys), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom_blocks(ids: DataFrame, keys: Sequence[str], count: int) -> tuple[DataFrame, int]:
    """The blocks that hold ``count`` keys, and how many blocks there are."""
    blocks = min(max(count // KEYS_IN_BLOCK, 1), MOST_BLOCKS)
    words = [F.bit_or(_bit(keys, k)).alias(f"_bloom_{k}") for k in range(WORDS)]
    return ids.groupBy(_block(keys, blocks).alias(_BLOCK)).agg(*words), blocks


def might_be_among(rows: DataFrame, ids: DataFrame, keys: Sequence[str], count: int | None = None) -> DataFrame:
    """The rows whose key is among ``ids``, and few others.

    The keys are counted first, unless ``count`` tells. However many there are, the filter has at most ``MOST_BLOCKS`` blocks: beyond some thirty
    million keys more of the other rows pass. Rows are tested where they are read; they aren't shuffled.
    """
    count = ids.count() if count is None else count
    table, blocks = bloom_blocks(ids, keys, count)
    tested = rows.withColumn(_BLOCK, _block(keys, blocks)).join(F.broadcast(table), _BLOCK)
    for k in range(WORDS):
        tested = tested.filter(F.col(f"_bloom_{k}").bitwiseAND(_bit(keys, k)) != 0)
    return tested.select(*[f"`{c}`" for c in rows.columns])
