"""Image features and blur reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photofold.config import DONE, BlurConfig
from photofold.functions.images import blur_threshold, dhash64, laplacian_var, mean_luma
from photofold.plans.bloom import might_be_among
from photofold.plans.hot_keys import BROADCAST_ROWS, first_rows, fits
from photofold.schemas import library_keys

NOT_FOUND = "Asset not found or no local URI"


def builtin_features(images: DataFrame) -> DataFrame:
    return images.withColumns(
        {
            "blur_score": laplacian_var("content"),
            "mean_luma": mean_luma("content"),
            "phash": dhash64("content"),
        }
    )


def image_features(
    images: DataFrame,
    features_fn: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``blur_score, mean_luma, phash, error_message`` of every image.

    ``features_fn`` replaces the built-in expressions (a pandas UDF over ``content``, say).
    Unreadable images (NULL content) get an error message instead of failing the job.
    """
    error = F.when(F.col("content").isNull(), NOT_FOUND)
    features = (features_fn or builtin_features)(images).withColumn("error_message", error)
    good = F.col("error_message").isNull()
    return features.select(
        *library_keys(images),
        "asset_id",
        *[F.when(good, F.col(c)).alias(c) for c in ("blur_score", "mean_luma", "phash")],
        "error_message",
    )


def wanted_images(ids: DataFrame, images: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """The images of the given assets, without moving their content.

    Up to ``few`` ids go to the images themselves; of more, a Bloom filter does, which lets few other images pass.
    """
    keys = [*library_keys(images), "asset_id"]
    narrow = ids.select(*keys)
    if fits(narrow, few):
        return images.join(F.broadcast(narrow), keys, "left_semi")
    return might_be_among(images, narrow, keys)


def features_of(
    ids: DataFrame, images: DataFrame, features_fn: Callable[[DataFrame], DataFrame] | None = None, few: int = BROADCAST_ROWS
) -> DataFrame:
    """``image_features`` of the given assets; an asset without an image row is an error row.

    Features are computed where the images are read, and only they are joined.
    """
    keys = [*library_keys(ids), "asset_id"]
    found = image_features(wanted_images(ids, images, few).select(*keys, "content"), features_fn)
    joined = ids.select(*keys).join(found.withColumn("_found", F.lit(True)), keys, "left")
    missing = F.when(F.col("_found").isNull(), NOT_FOUND).otherwise(F.col("error_message"))
    return joined.withColumn("error_message", missing).drop("_found")


def detect_blur(assets: DataFrame, config: BlurConfig = BlurConfig()) -> DataFrame:
    """Blurred or not, with the threshold adjusted to the lighting."""
    threshold = blur_threshold("mean_luma", config)
    return assets.select(
        *library_keys(assets),
        "asset_id",
        "blur_score",
        "mean_luma",
        (F.col("blur_score") < threshold).alias("is_blurry"),
        threshold.alias("adjusted_threshold"),
    )


def blur_score_only(images: DataFrame) -> DataFrame:
    return images.select(
        *library_keys(images),
        "asset_id",
        laplacian_var("content").alias("blur_score"),
        mean_luma("content").alias("mean_luma"),
    )


def blurry_static(
    assets: DataFrame, threshold: float = 100.0, limit: int | None = None
) -> DataFrame:
    """Processed assets under the fixed threshold, blurriest first; with a limit, so many of each library."""
    rows = assets.filter((F.col("status") == DONE) & (F.col("blur_score") < threshold)).select(
        *library_keys(assets), "asset_id", "blur_score", "mean_luma"
    )
    return first_rows(rows, library_keys(assets), [F.asc("blur_score"), F.asc("asset_id")], limit)


def live_only(report: DataFrame, listing: DataFrame) -> DataFrame:
    """Report rows whose media still resolves, with the URI to show."""
    uri = F.coalesce(F.nullif(F.col("local_uri"), F.lit("")), F.nullif(F.col("uri"), F.lit("")))
    live = listing.select(*library_keys(report), "asset_id", uri.alias("uri"))
    return report.join(live.filter(F.col("uri").isNotNull()), [*library_keys(report), "asset_id"])
