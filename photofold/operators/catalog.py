"""The asset catalog: sync, upserts, status changes, lookups and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photofold.config import DONE, ERROR, PENDING, SCAN_BATCH_ROWS
from photofold.plans.hot_keys import broadcast_if_fits, first_rows, rank_in_key
from photofold.plans.ordering import POSITION, with_position
from photofold.schemas import library_keys

INSERT, RESET, KEEP = "insert", "reset", "keep"


def sync_catalog(catalog: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """Catalog after a listing was seen, with an ``action`` column.

    New ids are inserted PENDING; a changed signature resets to PENDING and is stored;
    everything else, also ids missing from the listing, stays as it is. ``listing`` has
    ``asset_id, creation_time, width, height, file_signature``, one row per id.
    """
    on = [*library_keys(catalog), "asset_id"]
    seen = listing.select(
        *on,
        F.col("creation_time").alias("_taken_at"),
        F.col("width").alias("_width"),
        F.col("height").alias("_height"),
        F.col("file_signature").alias("_signature"),
        F.lit(True).alias("_seen"),
    )
    both = catalog.withColumn("_known", F.lit(True)).join(seen, on, "full")
    new = F.col("_known").isNull()
    # A stored NULL signature differs from any real one, hence the null-safe test.
    changed = F.col("_seen") & ~F.col("file_signature").eqNullSafe(F.col("_signature"))
    action = F.when(new, INSERT).when(changed, RESET).otherwise(KEEP)
    touched = new | F.coalesce(changed, F.lit(False))
    fresh = {"taken_at": "_taken_at", "width": "_width", "height": "_height"}
    columns = []
    for name in catalog.columns:
        if name in fresh:
            value = F.when(new, F.col(fresh[name])).otherwise(F.col(name))
        elif name == "file_signature":
            value = F.when(touched, F.col("_signature")).otherwise(F.col(name))
        elif name == "status":
            value = F.when(touched, PENDING).otherwise(F.col(name))
        elif name == "updated_at":
            value = F.when(touched, now).otherwise(F.col(name))
        elif name == "face_count":
            value = F.when(new, 0).otherwise(F.col(name))
        else:
            value = F.col(name)
        columns.append(value.alias(name))
    return both.select(*columns, action.alias("action"))


def fold_updates(updates: DataFrame, seq: str, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """One row per asset from a log of partial updates: the last non-NULL value of each field.

    ``status`` counts as PENDING where an update leaves it out. A plain aggregation, so
    repeated updates of one asset combine before the shuffle.
    """
    aggs = []
    for name in updates.columns:
        if name in keys or name == seq:
            continue
        if name == "status":
            aggs.append(F.max_by(F.coalesce(F.col(name), F.lit(PENDING)), seq).alias(name))
        else:
            aggs.append(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq))).alias(name))
    return updates.groupBy(*keys).agg(*aggs)


def upsert_coalesce(
    catalog: DataFrame, updates: DataFrame, seq: str, now: Column | None = None
) -> DataFrame:
    """Insert new assets; overwrite only the fields an update carries.

    ``status`` falls back to PENDING on updates, too. ``updated_at`` becomes ``now``
    on touched rows.
    """
    keys = [*library_keys(catalog), "asset_id"]
    source = fold_updates(updates, seq, keys)
    carried = [c for c in source.columns if c not in keys]
    renamed = source.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in carried], F.lit(True).alias("_touched")
    )
    both = catalog.join(renamed, keys, "full")
    columns = []
    for name in catalog.columns:
        if name == "updated_at" and now is not None:
            value = F.when(F.col("_touched"), now).otherwise(F.col(name))
        elif name == "status" and name not in carried:
            value = F.when(F.col("_touched"), PENDING).otherwise(F.col(name))
        elif name in carried:
            value = F.coalesce(F.col(f"_new_{name}"), F.col(name))
        else:
            value = F.col(name)
        columns.append(value.alias(name))
    return both.select(*columns)


def insert_or_replace(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str
) -> DataFrame:
    """Last write per primary key; ``existing`` rows are older than all incoming ones."""
    columns = existing.columns
    rows = existing.withColumn("_seq", F.lit(None).cast("bigint")).unionByName(
        incoming.select(*columns, F.col(seq).cast("bigint").alias("_seq"))
    )
    order = F.struct(F.col("_seq").isNotNull(), F.col("_seq"))
    values = [c for c in columns if c not in keys]
    last = F.max_by(F.struct(*values), order).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*columns)


def mark_results(
    catalog: DataFrame, results: DataFrame, version: int, now: Column
) -> DataFrame:
    """Write a batch of scan results, one row per asset.

    ``results`` has ``asset_id, blur_score, mean_luma, phash, error_message`` and maybe
    ``labels_json, face_count``: rows with an error become ERROR and keep their features,
    the others DONE with all the new values (stale labels do not survive a re-scan).
    """
    keys = [*library_keys(catalog), "asset_id"]
    fields = ["blur_score", "mean_luma", "phash"]
    fields += [c for c in ("labels_json", "face_count") if c in results.columns]
    incoming = results.select(
        *keys,
        *[F.col(c).alias(f"_new_{c}") for c in [*fields, "error_message"]],
        F.lit(True).alias("_touched"),
    )
    both = catalog.join(incoming, keys, "left")
    touched = F.coalesce(F.col("_touched"), F.lit(False))
    done = touched & F.col("_new_error_message").isNull()
    new_values = {
        **{c: F.when(done, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields},
        "error_message": F.when(touched, F.col("_new_error_message")).otherwise(
            F.col("error_message")
        ),
        "status": F.when(done, DONE).when(touched, ERROR).otherwise(F.col("status")),
        "algo_version": F.when(done, version).otherwise(F.col("algo_version")),
        "updated_at": F.when(touched, now).otherwise(F.col("updated_at")),
    }
    return both.select(*[new_values.get(c, F.col(c)).alias(c) for c in catalog.columns])


def _outdated(version: int) -> Column:
    return (F.col("status") == DONE) & (
        F.col("algo_version").isNull() | (F.col("algo_version") < version)
    )


def reset_outdated(catalog: DataFrame, version: int, now: Column) -> DataFrame:
    """DONE assets of an older algorithm version go back to PENDING."""
    old = _outdated(version)
    return catalog.withColumns(
        {
            "status": F.when(old, PENDING).otherwise(F.col("status")),
            "updated_at": F.when(old, now).otherwise(F.col("updated_at")),
        }
    )


def count_outdated(catalog: DataFrame, version: int) -> DataFrame:
    return catalog.agg(F.count_if(_outdated(version)).alias("reset_count"))


def reset_all(catalog: DataFrame, now: Column) -> DataFrame:
    """Everything back to PENDING; features and version stay."""
    return catalog.withColumns(
        {
            "status": F.lit(PENDING),
            "face_count": F.lit(None).cast("int"),
            "labels_json": F.lit(None).cast("string"),
            "error_message": F.lit(None).cast("string"),
            "updated_at": now,
        }
    )


@dataclass(frozen=True)
class Reset:
    catalog: DataFrame
    groups: DataFrame
    members: DataFrame
    meta: DataFrame


def reset_library(
    catalog: DataFrame, groups: DataFrame, members: DataFrame, meta: DataFrame, now: Column
) -> Reset:
    """A fresh start: every asset PENDING, no groups, no members and no scan cursor."""
    cursor = F.col("key").isin("scan_cursor_taken_at", "scan_cursor_asset_id")
    return Reset(reset_all(catalog, now), groups.limit(0), members.limit(0), meta.filter(~cursor))


def retry_errors(catalog: DataFrame, now: Column) -> DataFrame:
    """Optional: give failed assets another scan."""
    failed = F.col("status") == ERROR
    return catalog.withColumns(
        {
            "status": F.when(failed, PENDING).otherwise(F.col("status")),
            "updated_at": F.when(failed, now).otherwise(F.col("updated_at")),
        }
    )


def lookup(table: DataFrame, key: str, values: Sequence[object] | DataFrame) -> DataFrame:
    """Rows whose key is wanted: a pushed-down filter for a list, a semi-join (within the library) for a table."""
    if isinstance(values, DataFrame):
        keys = [*[k for k in library_keys(table) if k in values.columns], key]
        return table.join(values.select(*keys), keys, "left_semi")
    return table.filter(F.col(key).isin(list(values)))


def group_of_asset(members: DataFrame) -> DataFrame:
    """The group of every asset (the first by id should one be in several)."""
    keys = [*library_keys(members), "asset_id"]
    return members.groupBy(*keys).agg(F.min("group_id").alias("group_id"))


def pending(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("status") == PENDING)


def keyset_page(
    catalog: DataFrame,
    after_taken_at: int | None = None,
    after_asset_id: str | None = None,
    limit: int | None = SCAN_BATCH_ROWS,
) -> DataFrame:
    """Next page of pending assets (of each library) in (taken_at, asset_id) order; NULL times first, only without cursor."""
    rows = pending(catalog)
    if after_taken_at is not None and after_asset_id is not None:
        taken_at, asset_id = F.col("taken_at"), F.col("asset_id")
        rows = rows.filter(
            (taken_at > after_taken_at)
            | ((taken_at == after_taken_at) & (asset_id > after_asset_id))
        )
    keys = library_keys(catalog)
    order = [F.asc_nulls_first("taken_at"), F.asc("asset_id")]
    return first_rows(rows.select(*keys, "asset_id", "taken_at"), keys, order, limit)


def scan_batches(catalog: DataFrame, batch_rows: int = SCAN_BATCH_ROWS) -> DataFrame:
    """Batch number of every pending asset in scan order (of its library), without a one-task window."""
    order = [F.asc_nulls_first("taken_at"), F.asc("asset_id")]
    keys = library_keys(catalog)
    rows = pending(catalog).select(*keys, "asset_id", "taken_at")
    if keys:
        rows = rank_in_key(rows, keys, order, "_rank").withColumn(POSITION, F.col("_rank") - 1)
    else:
        rows = with_position(rows, order)
    return rows.select(
        *keys, "asset_id", "taken_at", F.floor(F.col(POSITION) / batch_rows).alias("batch")
    )


def status_counts(catalog: DataFrame) -> DataFrame:
    """Pending, done and error counts; NULLs for an empty catalog."""

    def total(status: int) -> Column:
        return F.sum(F.when(F.col("status") == status, 1).otherwise(0))

    keys = library_keys(catalog)
    return catalog.groupBy(*keys).agg(
        total(PENDING).alias("pending"), total(DONE).alias("done"), total(ERROR).alias("error")
    )


def late_assets(
    catalog: DataFrame,
    cursor_taken_at: int | None = None,
    cursor_asset_id: str | None = None,
    cursors: DataFrame | None = None,
) -> DataFrame:
    """Pending assets at or before the scan cursor, which a forward-only scan never reaches.

    ``cursors`` (library_id, cursor_taken_at, cursor_asset_id) has a cursor per library; a library
    without one has no late assets.
    """
    rows = pending(catalog)
    if cursors is not None:
        rows = rows.join(broadcast_if_fits(cursors), library_keys(catalog))
        at, last_id = F.col("cursor_taken_at"), F.col("cursor_asset_id")
    else:
        at, last_id = F.lit(cursor_taken_at), F.lit(cursor_asset_id)
    taken_at = F.col("taken_at")
    reached = (taken_at > at) | ((taken_at == at) & (F.col("asset_id") > last_id))
    late = rows.filter(~F.coalesce(reached, F.lit(False)))
    return late.select(*library_keys(catalog), "asset_id", "taken_at")


def replace_cursor(meta: DataFrame, catalog: DataFrame) -> DataFrame:
    """Meta table with the scan cursor (of each library) moved to the last scanned asset."""
    keys = library_keys(catalog)
    scanned = catalog.filter((F.col("status") != PENDING) & F.col("taken_at").isNotNull())
    last = scanned.groupBy(*keys).agg(F.max(F.struct("taken_at", "asset_id")).alias("at"))
    rows = last.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.lit("scan_cursor_taken_at").alias("key"),
                    F.col("at.taken_at").cast("string").alias("value"),
                ),
                F.struct(
                    F.lit("scan_cursor_asset_id").alias("key"), F.col("at.asset_id").alias("value")
                ),
            )
        ).alias("kv"),
        F.lit(1).alias("seq"),
    ).select(*keys, "kv.*", "seq")
    return insert_or_replace(meta, rows.filter(F.col("value").isNotNull()), [*keys, "key"], "seq")
