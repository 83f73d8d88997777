"""Review queue: batches to look at and the state that a log of actions leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photofold.config import FAILURES_TO_TRIP
from photofold.plans.hot_keys import first_rows, join_small, salted_join, top_n_per_key
from photofold.plans.ordering import (
    HOME,
    block_window,
    in_blocks,
    with_position,
    with_running_total,
)
from photofold.schemas import library_keys

NEWEST, OLDEST, RANDOM = "newest", "oldest", "random"


def _time_order(order: str) -> list[Column]:
    if order == OLDEST:
        return [F.asc("creation_time"), F.asc("asset_id")]
    return [F.desc("creation_time"), F.desc("asset_id")]


def _shuffled(seed: int) -> list[Column]:
    """Repeatable shuffle: by a seeded digest of the id."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col("asset_id"))), F.col("asset_id")]


def shuffle(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(*_shuffled(seed))


def scan_media(
    listing: DataFrame,
    media_type: str = "photo",
    bridge: DataFrame | None = None,
    album_ids: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Assets of one media type, oldest first, of some albums or all."""
    rows = listing.filter(F.col("media_type") == media_type)
    if album_ids and bridge is not None:
        wanted = bridge.filter(F.col("album_id").isin(list(album_ids)))
        keys = [*library_keys(listing), "asset_id"]
        rows = rows.join(wanted.select(*keys), keys, "left_semi")
    order = [F.asc("creation_time"), F.asc("asset_id")]
    return first_rows(rows, library_keys(listing), order, limit)


def album_restrict(
    listing: DataFrame, bridge: DataFrame, album_ids: Sequence[str] = ()
) -> DataFrame:
    """Assets of the selected albums, one row per album they are in; no selection means all."""
    if not album_ids:
        return listing.withColumn("album_id", F.lit(None).cast("string"))
    keys = [*library_keys(listing), "asset_id"]
    wanted = bridge.filter(F.col("album_id").isin(list(album_ids))).select(*keys, "album_id")
    return listing.join(wanted, keys)


def union_albums(
    listing: DataFrame, bridge: DataFrame, album_ids: Sequence[str], distinct: bool = False
) -> DataFrame:
    """Album contents one after the other, repeats kept unless ``distinct``."""
    rows = album_restrict(listing, bridge, album_ids).select(
        *library_keys(listing), "asset_id", "creation_time"
    )
    return rows.distinct() if distinct else rows


def per_album_top_n(
    listing: DataFrame, bridge: DataFrame, n: int, order: str = NEWEST
) -> DataFrame:
    """Newest (or oldest) ``n`` assets of every album."""
    keys = [*library_keys(listing), "asset_id"]
    rows = bridge.join(listing.select(*keys, "creation_time"), keys)
    album = [*library_keys(listing), "album_id"]
    top = top_n_per_key(rows, album, _time_order(order), n)
    return top.withColumnRenamed("_rank", "album_rank")


def anti_processed(listing: DataFrame, processed: DataFrame) -> DataFrame:
    keys = [*library_keys(listing), "asset_id"]
    return listing.join(processed.select(*keys), keys, "left_anti")


def review_batch(
    listing: DataFrame,
    bridge: DataFrame,
    processed: DataFrame,
    count: int,
    media_type: str = "photo",
    order: str = RANDOM,
    album_ids: Sequence[str] = (),
    source_cap: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """The next assets to review, ``count`` of each library.

    Assets already reviewed are skipped; a random order shuffles what is left. With a
    ``source_cap`` each source (a selected album, or the whole library) offers only its first
    so many assets, reviewed or not.
    """
    libraries = library_keys(listing)
    media = listing.filter(F.col("media_type") == media_type)
    by_time = _time_order(order)
    if album_ids:
        places = {album: i for i, album in enumerate(album_ids)}
        wanted = bridge.filter(F.col("album_id").isin(list(places)))
        keys = [*libraries, "asset_id"]
        if source_cap is None:
            offered = wanted.join(media.select(*keys, "creation_time"), keys)
        else:
            offered = per_album_top_n(media, wanted, source_cap, order)
        place = F.coalesce(*[F.when(F.col("album_id") == a, i) for a, i in places.items()])
        by_time = [place, *by_time]
    else:
        offered = media if source_cap is None else first_rows(media, libraries, by_time, source_cap)
        offered = offered.withColumn("album_id", F.lit(None).cast("string"))
    fresh = anti_processed(offered, processed)
    by = _shuffled(seed) + [F.col("album_id")] if order == RANDOM else by_time
    return first_rows(fresh, libraries, by, count).select(
        *libraries, "asset_id", "album_id", "creation_time"
    )


def total_counts(listing: DataFrame) -> DataFrame:
    return listing.groupBy(*library_keys(listing), "media_type").agg(F.count(F.lit(1)).alias("total"))


def review_progress(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Reviewed and total assets per media type."""
    keys = [*library_keys(listing), "media_type"]
    done = state.groupBy(*keys).agg(F.count_if(F.col("processed")).alias("processed"))
    return (
        total_counts(listing)
        .join(done, keys, "left")
        .select(*keys, F.coalesce("processed", F.lit(0)).alias("processed"), "total")
    )


def album_list(albums: DataFrame, bridge: DataFrame) -> DataFrame:
    """Albums with their asset counts, empty ones included."""
    keys = [*library_keys(bridge), "album_id"]
    counts = bridge.groupBy(*keys).agg(F.count(F.lit(1)).alias("asset_count"))
    return albums.join(counts, keys, "left").withColumn(
        "asset_count", F.coalesce("asset_count", F.lit(0))
    )


def album_move(
    bridge: DataFrame, listing: DataFrame, moves: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add assets to albums and drop the originals: new bridge, new listing, processed ids."""
    keys = [*library_keys(bridge), "asset_id"]
    added = moves.select(*bridge.columns)
    moved = moves.select(*keys).distinct()
    return bridge.unionByName(added).distinct(), listing.join(moved, keys, "left_anti"), moved


def queue_preview(state: DataFrame, n: int = 9) -> DataFrame:
    """First ``n`` assets of the delete queue and how many more wait."""
    keys = [*library_keys(state), "media_type"]
    queued = state.filter(F.col("in_delete_queue")).select(*keys, "asset_id", "queued_at")
    shown = top_n_per_key(queued, keys, [F.asc("queued_at"), F.asc("asset_id")], n)
    head = shown.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_rank", "asset_id"))).alias("_shown")
    )
    total = queued.groupBy(*keys).agg(F.count(F.lit(1)).alias("queued"))
    return head.join(total, keys).select(
        *keys,
        F.transform("_shown", lambda r: r["asset_id"]).alias("shown"),
        "queued",
        F.greatest(F.col("queued") - n, F.lit(0)).alias("overflow"),
    )


# Actions that apply to a whole media type rather than to one asset.
CLEARS_DELETE = ["confirm", "confirm_failed", "batch_reset", "load", "progress_reset"]
CLEARS_COLLECTION = ["batch_reset", "load", "progress_reset"]
CLEARS_TRASH = ["confirm", "progress_reset"]
MARKS_PHOTO = ["delete", "collect", "skip", "album"]
MARKS_VIDEO = ["trash", "processed"]


def _last(actions: Sequence[str]) -> Column:
    return F.max(F.when(F.col("action").isin(list(actions)), F.col("seq")))


def _after(a: Column, b: Column) -> Column:
    """``a`` happened, and later than ``b`` if that happened at all."""
    return F.coalesce(a > b, a.isNotNull())


def _latest(*columns: Column) -> Column:
    return F.greatest(*columns)


def _with_global_marks(per_asset: DataFrame, events: DataFrame) -> DataFrame:
    """Add the last global action of each kind: one row per media type (and library)."""
    keys = [*library_keys(events), "media_type"]
    marks = (
        events.filter(F.col("asset_id").isNull())
        .groupBy(*keys)
        .agg(
            _last(CLEARS_DELETE).alias("_clear_delete"),
            _last(CLEARS_COLLECTION).alias("_clear_collection"),
            _last(CLEARS_TRASH).alias("_clear_trash"),
            _last(["progress_reset"]).alias("_reset"),
        )
    )
    return join_small(per_asset, marks, keys, "left")


def fold_photos(events: DataFrame) -> DataFrame:
    """Per photo: reviewed?, in the delete queue?, in the collection queue?

    Comparing the last time of each action is enough, so this is one aggregation that
    combines before the shuffle, however often one photo was acted on.
    """
    keys = [*library_keys(events), "media_type", "asset_id"]
    rows = events.filter((F.col("media_type") == "photo") & F.col("asset_id").isNotNull())
    per_asset = rows.groupBy(*keys).agg(
        _last(MARKS_PHOTO).alias("_marked"),
        _last(["undo"]).alias("_undo"),
        _last(["delete"]).alias("_delete"),
        _last(["collect"]).alias("_collect"),
    )
    folded = _with_global_marks(per_asset, events)
    undo = F.col("_undo")
    in_delete = _after(F.col("_delete"), _latest(undo, F.col("_clear_delete")))
    return folded.select(
        *keys,
        _after(F.col("_marked"), _latest(undo, F.col("_reset"))).alias("processed"),
        in_delete.alias("in_delete_queue"),
        _after(F.col("_collect"), _latest(undo, F.col("_clear_collection"))).alias(
            "in_collection_queue"
        ),
        F.lit(False).alias("in_trash"),
        F.when(in_delete, F.col("_delete")).alias("queued_at"),
    )


def effective_restores(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Video actions with restores outside the trash removed.

    A restore works iff the asset's previous trash or restore was a trash and no global
    clearing lies between. Clearings are counted along the log, so "between" is a comparison
    of two counts; the previous action is one row back in (asset, seq) order.
    """
    keys = library_keys(events)
    video = events.filter(F.col("media_type") == "video").select(
        *keys, "media_type", "asset_id", "seq", "action"
    )
    clearing = F.when(F.col("asset_id").isNull() & F.col("action").isin(CLEARS_TRASH), 1).otherwise(0)
    # Stored state comes back with one seq for all, so the id is needed to make the order unique.
    counted = with_running_total(video, [*keys, "seq", "asset_id"], "_epoch", clearing)
    moves = counted.filter(F.col("asset_id").isNotNull() & F.col("action").isin("trash", "restore"))
    positioned = with_position(
        moves.select(*keys, "media_type", "asset_id", "seq", "action", "_epoch"), [*keys, "asset_id", "seq"]
    )
    blocks = in_blocks(positioned, 1, *([block_rows] if block_rows else []))
    previous = F.lag(F.struct(*keys, "asset_id", "action", "_epoch"), 1).over(block_window())
    linked = blocks.withColumn("_previous", previous).filter(HOME)
    same = F.col("_previous.asset_id") == F.col("asset_id")
    for key in keys:
        same = same & (F.col(f"_previous.{key}") == F.col(key))
    works = (
        same
        & (F.col("_previous.action") == "trash")
        & (F.col("_previous._epoch") == F.col("_epoch"))
    )
    restores = linked.filter((F.col("action") == "restore") & works)
    return restores.select(*keys, "media_type", "asset_id", "seq", "action")


def fold_videos(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Per video: reviewed?, in the trash?"""
    keys = [*library_keys(events), "media_type", "asset_id"]
    rows = events.filter((F.col("media_type") == "video") & F.col("asset_id").isNotNull())
    action = F.when(F.col("action") == "restore", "try_restore").otherwise(F.col("action"))
    per_asset = (
        rows.select(*keys, "seq", action.alias("action"))
        .unionByName(effective_restores(events, block_rows))
        .groupBy(*keys)
        .agg(
            _last(MARKS_VIDEO).alias("_marked"),
            _last(["trash"]).alias("_trash"),
            _last(["restore"]).alias("_restore"),
            _last(["try_restore"]).alias("_try_restore"),
        )
    )
    folded = _with_global_marks(per_asset, events)
    return folded.select(
        *keys,
        _after(F.col("_marked"), _latest(F.col("_restore"), F.col("_reset"))).alias("processed"),
        F.lit(False).alias("in_delete_queue"),
        F.lit(False).alias("in_collection_queue"),
        _after(F.col("_trash"), _latest(F.col("_try_restore"), F.col("_clear_trash"))).alias(
            "in_trash"
        ),
        F.lit(None).cast("bigint").alias("queued_at"),
    )


def review_fold(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Review state of every asset after the whole log (``seq`` is unique)."""
    return fold_photos(events).unionByName(fold_videos(events, block_rows))


def failure_streak(
    attempts: DataFrame, to_trip: int = FAILURES_TO_TRIP, block_rows: int | None = None
) -> DataFrame:
    """Attempts of each session with ``disabled`` set after ``to_trip`` failures in a row.

    A look-back of ``to_trip - 1`` rows finds the streaks; the first one of a session wins.
    """
    keys = [*library_keys(attempts), "session_id"]
    positioned = with_position(attempts, [*keys, "seq"])
    blocks = in_blocks(positioned, to_trip - 1, *([block_rows] if block_rows else []))
    window = block_window()
    full = F.col("failed")
    for k in range(1, to_trip):
        back = F.lag(F.struct(*keys, "failed"), k).over(window)
        blocks = blocks.withColumn(f"_back{k}", back)
        for key in keys:
            full = full & (F.col(f"_back{k}.{key}") == F.col(key))
        full = full & F.col(f"_back{k}.failed")
    streaks = blocks.filter(HOME).filter(full)
    trips = streaks.groupBy(*keys).agg(F.min("seq").alias("tripped_at"))
    return salted_join(attempts, trips, keys, "left").withColumn(
        "disabled", F.coalesce(F.col("seq") > F.col("tripped_at"), F.lit(False))
    )
