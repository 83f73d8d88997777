"""The whole scan: catalog sync, features, labels, status, groups and best shots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from photofold.config import SimilarityConfig
from photofold.functions.labels import serialize_labels, valid_face_count
from photofold.operators.catalog import mark_results, pending, reset_outdated, sync_catalog
from photofold.operators.groups import groups_of, update_best_shots
from photofold.operators.quality import features_of, wanted_images
from photofold.operators.similarity import dup_groups
from photofold.schemas import library_keys
from photofold.session import cut_lineage


@dataclass(frozen=True)
class Scan:
    catalog: DataFrame
    members: DataFrame
    groups: DataFrame


def scan_pending(
    catalog: DataFrame,
    images: DataFrame,
    version: int,
    now: Column,
    detections: DataFrame | None = None,
    features_fn: Callable[[DataFrame], DataFrame] | None = None,
    labels_fn: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Catalog after all PENDING assets were processed.

    ``images`` is (asset_id, content); an asset without an image becomes an ERROR row.
    ``detections`` is (asset_id, labels, faces) where classification is switched on; instead
    ``labels_fn`` makes that table from the images (a pandas UDF over ``content``, say).
    The content of an image never leaves the task that reads it.
    """
    keys = [*library_keys(catalog), "asset_id"]
    todo = pending(catalog).select(*keys, "width")
    results = features_of(todo, images, features_fn)
    if labels_fn is not None:
        detections = labels_fn(wanted_images(todo, images))
    if detections is not None:
        found = todo.join(detections.select(*keys, "labels", "faces"), keys, "left").select(
            *keys,
            serialize_labels("labels").alias("labels_json"),
            valid_face_count("faces", "labels", "width").alias("face_count"),
        )
        results = results.join(found, keys)
    return mark_results(catalog, results, version, now)


def scan(
    catalog: DataFrame,
    listing: DataFrame,
    images: DataFrame,
    version: int,
    now: Column,
    detections: DataFrame | None = None,
    config: SimilarityConfig = SimilarityConfig(),
    features_fn: Callable[[DataFrame], DataFrame] | None = None,
    labels_fn: Callable[[DataFrame], DataFrame] | None = None,
) -> Scan:
    """Sync with the listing, process what is pending, then group the whole catalog.

    The scanned catalog is written once, so that grouping and scoring do not repeat the
    features; for groups that grow with the arrivals see ``streaming.groups``.
    """
    synced = sync_catalog(catalog, listing, now).drop("action")
    due = reset_outdated(synced, version, now)
    scanned = cut_lineage(scan_pending(due, images, version, now, detections, features_fn, labels_fn))
    members = dup_groups(scanned, config)
    return Scan(scanned, members, update_best_shots(groups_of(members, now), members, scanned))

