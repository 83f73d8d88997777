"""Upkeep and reports of duplicate groups, and the best shot of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photofold.functions.images import lighting_score, resolution_score, sharpness_score
from photofold.plans.hot_keys import rank_in_key, salted_join, top_n_per_key
from photofold.schemas import library_keys
from photofold.session import cut_lineage


def _group(df: DataFrame) -> list[str]:
    return [*library_keys(df), "group_id"]


def groups_of(members: DataFrame, created_at: Column) -> DataFrame:
    """Group rows of a membership table with representatives."""
    return (
        members.groupBy(*_group(members))
        .agg(F.min("representative_asset_id").alias("representative_asset_id"))
        .withColumn("best_asset_id", F.lit(None).cast("string"))
        .withColumn("created_at", created_at.cast("bigint"))
    )


def final_targets(mapping: DataFrame, keys: Sequence[str] = (), most_rounds: int = 40) -> DataFrame:
    """Each source with the end of its chain of targets.

    Chains are halved in each round, so 40 rounds are enough for any table; what is left then goes in a
    circle, which is an error. The driver sees one count per round.
    """
    ids = [*keys, "source_id"]
    now = cut_lineage(mapping.select(*ids, "target_id").filter("source_id <> target_id").distinct())
    for _ in range(most_rounds):
        after = now.select(*keys, F.col("source_id").alias("target_id"), F.col("target_id").alias("_further"))
        joined = cut_lineage(now.join(after, [*keys, "target_id"], "left"))
        if joined.filter(F.col("_further").isNotNull()).isEmpty():
            return now
        moved = joined.select(*ids, F.coalesce("_further", "target_id").alias("target_id"))
        if not moved.filter("source_id = target_id").isEmpty():
            break
        now = moved
    raise ValueError("the mapping goes in a circle")


def merge_groups(
    groups: DataFrame, members: DataFrame, mapping: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Move the members of ``source_id`` groups to ``target_id`` and drop the source groups.

    A target that is merged itself passes its members on. An asset that is already in the
    target keeps its smaller distance.
    """
    key = _group(members)
    # A hot group has many members but one mapping row.
    renamed = final_targets(mapping, key[:-1]).select(
        *key[:-1], F.col("source_id").alias("group_id"), F.col("target_id").alias("_target")
    )
    moved = salted_join(members, renamed, key, "left").withColumn(
        "group_id", F.coalesce("_target", "group_id")
    )
    merged = moved.groupBy(*key, "asset_id").agg(F.min("distance").alias("distance"))
    return groups.join(renamed, key, "left_anti"), merged


def delete_groups(
    groups: DataFrame, members: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove the listed groups and their members."""
    key = _group(groups)
    ids = gone.select(*key).distinct()
    flagged = ids.withColumn("_gone", F.lit(True))
    kept = salted_join(members, flagged, key, "left").filter(F.col("_gone").isNull()).drop("_gone")
    return groups.join(ids, key, "left_anti"), kept


def list_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("created_at"), "group_id")


def group_members(members: DataFrame) -> DataFrame:
    """Members in display order: ``member_rank`` 1, 2, … by distance, then id."""
    ranked = rank_in_key(members, _group(members), ["distance", "asset_id"], "member_rank")
    return ranked.select(*_group(members), "asset_id", "distance", "member_rank")


def group_assets(groups: DataFrame, members: DataFrame, assets: DataFrame) -> DataFrame:
    """Catalog rows of all members; members whose asset is gone drop out."""
    key = _group(members)
    known = salted_join(members.select(*key, "asset_id"), groups.select(*key), key)
    return known.join(assets, [*library_keys(members), "asset_id"])


def score_assets(assets: DataFrame) -> DataFrame:
    """Resolution, sharpness and lighting parts and their sum."""
    parts = assets.withColumns(
        {
            "resolution": resolution_score(F.col("width"), F.col("height")),
            "sharpness": sharpness_score(F.col("blur_score")),
            "lighting": lighting_score(F.col("mean_luma")),
        }
    )
    return parts.withColumn("score", F.col("resolution") + F.col("sharpness") + F.col("lighting"))


def best_shot(members: DataFrame, assets: DataFrame) -> DataFrame:
    """Highest-scoring member per group, lowest id on ties.

    A minimum per group, not a window: members of a hot group combine before the shuffle.
    Groups without a resolvable asset have no row here.
    """
    key = _group(members)
    scored = score_assets(assets).select(*library_keys(assets), "asset_id", "score")
    joined = members.select(*key, "asset_id").join(scored, [*library_keys(members), "asset_id"])
    best = F.min(F.struct((-F.col("score")).alias("_by"), F.col("asset_id"))).alias("_best")
    return (
        joined.groupBy(*key)
        .agg(best)
        .select(
            *key, F.col("_best.asset_id").alias("best_asset_id"), (-F.col("_best._by")).alias("score")
        )
    )


def best_rank(members: DataFrame, assets: DataFrame) -> DataFrame:
    """Rank of every member by score within its group."""
    key = _group(members)
    scored = score_assets(assets).select(*library_keys(assets), "asset_id", "score")
    joined = members.select(*key, "asset_id").join(scored, [*library_keys(members), "asset_id"])
    return rank_in_key(joined, key, [F.desc("score"), F.asc("asset_id")], "best_rank")


def update_best_shots(groups: DataFrame, members: DataFrame, assets: DataFrame) -> DataFrame:
    """Groups with ``best_asset_id`` recomputed and a ``changed`` flag."""
    key = _group(groups)
    new = best_shot(members, assets).select(*key, F.col("best_asset_id").alias("_new"))
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("best_asset_id"))
    return (
        groups.join(new, key, "left")
        .withColumn("changed", changed)
        .withColumn("best_asset_id", F.coalesce("_new", "best_asset_id"))
        .drop("_new")
    )


def count_best_shot_changes(groups: DataFrame, members: DataFrame, assets: DataFrame) -> DataFrame:
    updated = update_best_shots(groups, members, assets)
    return updated.agg(F.count_if(F.col("changed")).alias("changed_groups"))


def _uri() -> Column:
    return F.coalesce(F.nullif(F.col("local_uri"), F.lit("")), F.nullif(F.col("uri"), F.lit("")))


def representative_uri(groups: DataFrame, members: DataFrame, listing: DataFrame) -> DataFrame:
    """Representative (else the first member) of each group and its URI, NULL when unresolved."""
    key = _group(groups)
    first = members.groupBy(*key).agg(
        F.min(F.struct("distance", "asset_id")).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    uris = listing.select(
        *library_keys(groups), "asset_id", _uri().alias("representative_uri")
    )
    return (
        groups.join(first, key, "left")
        .withColumn("asset_id", F.coalesce("representative_asset_id", "_first.asset_id"))
        .join(uris, [*library_keys(groups), "asset_id"], "left")
        .select(
            *key,
            "representative_uri",
            F.coalesce("_n", F.lit(0)).alias("member_count"),
            "best_asset_id",
            "created_at",
        )
    )


def summary_members(groups: DataFrame, members: DataFrame, listing: DataFrame) -> DataFrame:
    """Members of the groups that ``group_summary`` reports, in display order: one row per member."""
    reported = group_summary(groups, members, listing).select(*_group(groups))
    ranked = group_members(members)
    return salted_join(ranked, reported, _group(groups))


def group_summary(groups: DataFrame, members: DataFrame, listing: DataFrame) -> DataFrame:
    """Groups of more than one member, newest first; ``group_members`` lists their members."""
    summary = representative_uri(groups, members, listing).filter(F.col("member_count") > 1)
    return summary.orderBy(F.desc("created_at"), "group_id")


def first_members(members: DataFrame, n: int) -> DataFrame:
    """The first ``n`` member ids of each group as an array, and how many more there are."""
    key = _group(members)
    shown = (
        top_n_per_key(members, key, [F.asc("distance"), F.asc("asset_id")], n)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "asset_id"))).alias("_shown"))
        .select(*key, F.transform("_shown", lambda m: m["asset_id"]).alias("shown"))
    )
    total = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return shown.join(total, key).select(
        *key, "shown", F.greatest(F.col("_n") - n, F.lit(0)).alias("overflow")
    )


def remaining_after_delete(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """Members left per group; ``processed`` once at most one remains."""
    key = _group(members)
    gone = deleted.select(*library_keys(members), "asset_id").distinct()
    flagged = members.join(
        gone.withColumn("_gone", F.lit(True)), [*library_keys(members), "asset_id"], "left"
    )
    left = F.count_if(F.col("_gone").isNull())
    return flagged.groupBy(*key).agg(left.alias("remaining"), (left <= 1).alias("processed"))


def processed_last(groups: DataFrame, processed: DataFrame) -> DataFrame:
    """Unprocessed groups first, each part newest first."""
    key = _group(groups)
    done = processed.select(*key).distinct().withColumn("processed", F.lit(True))
    return (
        groups.join(done, key, "left")
        .withColumn("processed", F.coalesce("processed", F.lit(False)))
        .orderBy("processed", F.desc("created_at"), "group_id")
    )


