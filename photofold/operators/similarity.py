"""Near-duplicates: candidate search, nearest earlier asset and group assignment.

A scan takes assets in (taken_at, asset_id) order. Each joins the group of the most
similar of the assets just before it, so groups are the trees of a forest whose
parents lie at most ``max_compare_count - 1`` rows back. That makes grouping a
look-back over the global order: fixed-size blocks resolve on their own, and only
the last few rows of each block need to be chased across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photofold.config import DONE, SimilarityConfig
from photofold.functions.images import hash_bits
from photofold.functions.labels import group_id
from photofold.plans.hot_keys import top_n_per_key
from photofold.plans.ordering import (
    BLOCK,
    BLOCK_ROWS,
    HOME,
    PART,
    POSITION,
    ROW_IN_PART,
    block_window,
    in_blocks,
    sorted_parts,
    with_position,
)
from photofold.schemas import library_keys
from photofold.session import cut_lineage, cut_lineage_in_order


def to_group(assets: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Scanned assets with a time, cut down to what grouping needs and ``extra`` columns."""
    scanned = (F.col("status") == DONE) & F.col("taken_at").isNotNull() & (F.col("taken_at") != 0)
    return assets.filter(scanned).select(
        *library_keys(assets), "asset_id", "taken_at", hash_bits("phash").alias("_bits"), *extra
    )


def _least(scores: list[Column]) -> Column:
    return F.least(*scores) if len(scores) > 1 else scores[0]


def _nearest_earlier(
    rows: DataFrame, config: SimilarityConfig, block_rows: int, with_parent_id: bool
) -> DataFrame:
    """Add ``_parent`` (position) and ``distance_to_parent`` by looking back in global order.

    ``rows`` has ``asset_id, taken_at, _bits`` and maybe ``library_id``. Rows without a
    usable hash take a place in the look-back but never match.
    """
    keys = library_keys(rows)
    look_back = config.max_compare_count - 1
    positioned = with_position(rows, [*keys, "taken_at", "asset_id"])
    blocks = in_blocks(positioned, look_back, block_rows)
    if look_back < 1:
        return blocks.withColumns(
            {"_parent": F.lit(None).cast("bigint"), "distance_to_parent": F.lit(None).cast("int")}
        )
    fields = [*keys, "taken_at", "_bits", *(["asset_id"] if with_parent_id else [])]
    steps = range(1, look_back + 1)
    earlier = blocks.select(
        "*",
        *[F.lag(F.struct(*fields), k).over(block_window()).alias(f"_back{k}") for k in steps],
    ).filter(HOME)

    def score(k: int) -> Column:
        """Distance and, below it, how far back: the least is the closest, then latest, match."""
        back = F.col(f"_back{k}")
        distance = F.bit_count(F.col("_bits").bitwiseXOR(back["_bits"]))
        near = (F.col("taken_at") - back["taken_at"] <= config.window_ms) & (
            distance < config.similar_threshold
        )
        for key in keys:
            near = near & (F.col(key) == back[key])
        return F.when(near, distance * (look_back + 1) + k)

    best = earlier.withColumn("_best", _least([score(k) for k in steps]))
    back_by = F.col("_best") % (look_back + 1)
    out = best.withColumns(
        {
            "_parent": F.col(POSITION) - back_by,
            "distance_to_parent": F.floor(F.col("_best") / (look_back + 1)).cast("int"),
        }
    )
    if with_parent_id:
        ids = F.array(*[F.col(f"_back{k}.asset_id") for k in steps])
        out = out.withColumn("parent_id", F.get(ids, (back_by - 1).cast("int")))
    return out.drop("_best", *[f"_back{k}" for k in steps])


def dup_edges(
    assets: DataFrame, config: SimilarityConfig = SimilarityConfig(), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Each asset's most similar earlier asset within the window and candidate count."""
    keys = library_keys(assets)
    linked = _nearest_earlier(to_group(assets), config, block_rows, with_parent_id=True)
    return linked.filter(F.col("_parent").isNotNull()).select(
        *keys, "asset_id", "parent_id", F.col("distance_to_parent").alias("distance")
    )


def count_compared(
    assets: DataFrame, config: SimilarityConfig = SimilarityConfig(), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """How many of the assets just before each one fall into its time window; none, no row."""
    keys = library_keys(assets)
    look_back = config.max_compare_count - 1
    positioned = with_position(to_group(assets), [*keys, "taken_at", "asset_id"])
    frame = block_window().rowsBetween(-look_back, -1)
    fields = [*keys, "taken_at"]
    framed = in_blocks(positioned, look_back, block_rows).withColumn(
        "_frame", F.collect_list(F.struct(*fields)).over(frame)
    )

    def near(earlier: Column) -> Column:
        inside = F.col("taken_at") - earlier["taken_at"] <= config.window_ms
        for key in keys:
            inside = inside & (F.col(key) == earlier[key])
        return inside

    counted = framed.filter(HOME).withColumn("compared", F.size(F.filter("_frame", near)))
    return counted.filter("compared > 0").select(
        *keys, "asset_id", F.col("compared").cast("bigint").alias("compared")
    )


def _resolve_block(block: pa.Table) -> pa.Table:
    """Follow parents inside one block; rows leading out keep the position they lead to."""
    block = block.sort_by(POSITION)
    first = block[POSITION][0].as_py()
    parent = block["_parent"].to_numpy()
    up = np.where(parent >= first, parent - first, np.arange(len(parent)))
    while True:
        further = up[up]
        if np.array_equal(further, up):
            break
        up = further
    leads_out = parent[up] >= 0  # the top row has a parent in the block before
    # A root that is not known yet stays NULL until the end rows are resolved.
    root = pc.if_else(pa.array(leads_out), pa.scalar(None, pa.string()), block["_root"].take(up))
    entry = pa.array(np.where(leads_out, parent[up], -1))
    kept = block.drop_columns(["_parent", "_root"])
    return kept.append_column("_root", root).append_column("_entry", entry)


def assign_roots(
    rows: DataFrame, config: SimilarityConfig, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``root_id``, ``distance_to_parent`` and ``grouped`` (a new asset that has a hash).

    ``rows`` has ``asset_id, taken_at, _bits, _root``: ``_root`` is NULL for assets to
    group, or the final root of an asset grouped earlier (streaming).
    """
    keys = library_keys(rows)
    linked = _nearest_earlier(rows, config, block_rows, with_parent_id=False)
    new = F.col("_root").isNull()
    links = linked.select(
        *keys,
        "asset_id",
        (F.col("_bits").isNotNull() & new).alias("grouped"),
        POSITION,
        BLOCK,
        "distance_to_parent",
        F.when(new, F.coalesce(F.col("_parent"), F.lit(-1))).otherwise(F.lit(-1)).alias("_parent"),
        F.coalesce("_root", "asset_id").alias("_root"),
    )
    resolved = _resolve(links, config.max_compare_count - 1, block_rows)
    return resolved.withColumnRenamed("_root", "root_id").drop(POSITION, BLOCK)


def _resolve(links: DataFrame, look_back: int, block_rows: int) -> DataFrame:
    """Replace each row's own id in ``_root`` by that of its topmost ancestor.

    Parents lie at most ``look_back`` positions back. Blocks resolve on their own; what
    leads out of a block leads to one of the last rows of the block before. Those last rows,
    numbered anew, are the same problem some hundred times smaller.
    """
    kept = [c for c in links.columns if c not in ("_parent", "_root")]
    types = ", ".join(f"{c} {links.schema[c].dataType.simpleString()}" for c in kept)
    resolved = cut_lineage(
        links.groupBy(BLOCK).applyInArrow(_resolve_block, f"{types}, _root string, _entry bigint")
    )
    leading_out = resolved.filter(F.col("_root").isNull())
    if not leading_out.limit(1).count():
        return resolved.drop("_entry")
    in_block = F.col(POSITION) % block_rows

    def end_number(position: Column) -> Column:
        block = F.floor(position / block_rows)
        return block * look_back + position % block_rows - (block_rows - look_back)

    # An end row and the one it leads to are less than two blocks' worth of end rows apart.
    next_back = 2 * look_back - 1
    next_rows = max(block_rows, 4 * next_back)
    ends = resolved.filter(in_block >= block_rows - look_back).select(
        end_number(F.col(POSITION)).alias(POSITION),
        F.when(F.col("_root").isNull(), end_number(F.col("_entry"))).otherwise(-1).alias("_parent"),
        "_root",
    )
    ends = ends.withColumn(BLOCK, F.floor(F.col(POSITION) / next_rows))
    found = _resolve(ends, next_back, next_rows).select(
        F.col(POSITION).alias("_at"), F.col("_root").alias("_end_root")
    )
    # Only rows that lead out are joined; at most one block of them shares a key.
    closed = leading_out.drop("_root").join(found, end_number(F.col("_entry")) == F.col("_at"))
    return (
        resolved.filter(F.col("_root").isNotNull())
        .unionByName(closed.withColumnRenamed("_end_root", "_root").drop("_at"))
        .drop("_entry")
    )


def dup_groups(
    assets: DataFrame, config: SimilarityConfig = SimilarityConfig(), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Group of every processed asset with a time and a hash.

    ``distance`` is 0 as a scan stores it (the closest match is the asset itself);
    ``distance_to_parent`` is the distance that put the asset into the group.
    """
    rows = to_group(assets).withColumn("_root", F.lit(None).cast("string"))
    return as_members(assign_roots(rows, config, block_rows).filter("grouped"))


def as_members(roots: DataFrame) -> DataFrame:
    keys = library_keys(roots)
    return roots.select(
        *keys,
        group_id(*keys, "root_id").alias("group_id"),
        "asset_id",
        F.col("root_id").alias("representative_asset_id"),
        F.lit(0).alias("distance"),
        "distance_to_parent",
    )


def _match_sorted(
    batches: Iterator[pd.DataFrame], keys: list[str], ends: Broadcast, config: SimilarityConfig
) -> Iterator[pd.DataFrame]:
    """Compare every probe with the newest catalog rows before it; batches arrive in order."""
    keep = config.max_compare_count
    carried: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        if carried is None:
            last = ends.value
            carried = last[last[PART] < batch[PART].iloc[0]].tail(keep)
        rows = pd.concat([carried, batch], ignore_index=True) if len(carried) else batch
        is_data = ~rows["_probe"].to_numpy(bool)
        data = rows[is_data]
        probes = rows[~is_data]
        seen = np.cumsum(is_data)[~is_data]  # catalog rows before each probe
        frames = []
        ids, bits = data["asset_id"].to_numpy(object), data["_bits"].to_numpy(np.int64)
        usable, times = data["_usable"].to_numpy(bool), data["_time"].to_numpy(np.int64)
        wanted = probes["_bits"].to_numpy(np.int64)
        earliest = probes["_time"].to_numpy(np.int64) - 2 * config.window_ms
        for k in range(1, keep + 1):
            at = seen - k
            live = np.flatnonzero(at >= 0)
            at = at[live]
            distance = np.bitwise_count((bits[at] ^ wanted[live]).view(np.uint64)).astype(np.int32)
            ok = (
                usable[at] & (times[at] >= earliest[live]) & (distance < config.similar_threshold)
            )
            for key in keys:
                ok &= data[key].to_numpy(object)[at] == probes[key].to_numpy(object)[live]
            chosen = live[ok]
            frames.append(
                pd.DataFrame(
                    {
                        **{key: probes[key].to_numpy(object)[chosen] for key in keys},
                        "target_id": probes["asset_id"].to_numpy(object)[chosen],
                        "asset_id": ids[at[ok]],
                        "distance": distance[ok],
                        "recency": np.full(len(chosen), k, np.int32),
                    }
                )
            )
        carried = data.tail(keep)
        yield pd.concat(frames, ignore_index=True)


def find_similar(
    catalog: DataFrame,
    targets: DataFrame,
    config: SimilarityConfig = SimilarityConfig(),
    exclude_self: bool = False,
) -> DataFrame:
    """Similar catalog assets of every target: ``target_id, asset_id, distance, recency``.

    Of the DONE assets within the window on both sides only the newest
    ``max_compare_count`` are compared (``recency`` 1 is the newest); those without a
    hash use up a place. Targets are merged into the time order as probes at the end of
    their window, so the candidates of a probe are simply the catalog rows just before
    it: one sort, no pair generation, however many assets share a time.
    """
    keys = library_keys(catalog)
    bits = F.coalesce(hash_bits("phash"), F.lit(0).cast("bigint")).alias("_bits")

    def rows(df: DataFrame, time: Column, probe: bool) -> DataFrame:
        usable = hash_bits("phash").isNotNull()
        return df.select(
            *keys, "asset_id", time.alias("_time"), F.lit(probe).alias("_probe"), bits,
            usable.alias("_usable"),
        )

    data = rows(
        catalog.filter((F.col("status") == DONE) & F.col("taken_at").isNotNull()),
        F.col("taken_at"),
        False,
    )
    probes = rows(
        targets.filter(F.col("taken_at").isNotNull()),
        F.col("taken_at") + config.window_ms,
        True,
    ).filter("_usable")
    in_time = [*keys, "_time", "_probe", "asset_id"]
    parts = sorted_parts(data.unionAll(probes), in_time, cut_lineage_in_order)
    last = _last_rows(parts, config.max_compare_count)
    ends = catalog.sparkSession.sparkContext.broadcast(last)
    types = "".join(f"{k} {catalog.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{types}target_id string, asset_id string, distance int, recency int"
    # The stored partitions are sorted and keep their row order, so batches come in order.
    matches = parts.mapInPandas(lambda it: _match_sorted(it, keys, ends, config), schema)
    return matches.filter(F.col("asset_id") != F.col("target_id")) if exclude_self else matches


def _last_rows(parts: DataFrame, n: int) -> pd.DataFrame:
    """The last ``n`` catalog rows of each sort partition.

    At most ``n`` rows per partition reach the driver: a bound that follows the
    partition count, not the data.
    """
    data = parts.filter(~F.col("_probe"))
    last = top_n_per_key(data, [PART], [F.desc(ROW_IN_PART)], n, salts=1).drop("_rank")
    return last.toPandas().sort_values([PART, ROW_IN_PART], ignore_index=True)
