"""Every operator applied to the whole derived tables, under its inventory name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from photofold.config import (
    BLUR_REPORT_ROWS,
    DONE,
    ERROR,
    MAX_LABELS,
    PENDING,
    PHOTO_SOURCE_CAP,
    SimilarityConfig,
)
from photofold.fixtures import views as v
from photofold.fixtures.oracles import NOW
from photofold.functions import images as img
from photofold.functions import labels as lab
from photofold.operators import catalog as cat
from photofold.operators import categories as cg
from photofold.operators import faces, groups, quality, review, similarity
from photofold.operators import scan as scanning
from photofold.plans.ordering import number_sorted
from photofold.schemas import FACE, MEDIA_LISTING
from photofold.session import cut_lineage, run_folder
from photofold.sources import clustered, media, pages, vocabulary
from photofold.streaming import catalog as stream_catalog
from photofold.streaming import ingest
from photofold.streaming.groups import GroupStream
from photofold.streaming.keyed import Arrivals, KeyedGroups, KeyedReview, StatusCounters
from photofold.streaming.regroup import GroupTable
from photofold.streaming.review import ReviewStream

Query = Callable[[SparkSession, str], DataFrame]

CURSOR = (1_705_000_000_000, "a")
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def joined(texts: Column) -> Column:
    return F.array_join(texts, "|").alias("texts")


def now() -> Column:
    return F.lit(NOW).cast("bigint")


def listing(spark: SparkSession, sf: str, media_type: str | None = None) -> DataFrame:
    rows = v.media_listing(spark, sf).withColumn("file_signature", media.file_signature("mtime", "size"))
    return rows.filter(F.col("media_type") == media_type) if media_type else rows


def state(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_fold(v.review_events(spark, sf))


def processed(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf).filter("processed").select("asset_id")


def vocabulary_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(v.VOCABULARY)), "idx int, label string")


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.number_lines(v.table(spark, sf, "documents"), "text", ["doc_id"])


def categorized(spark: SparkSession, sf: str) -> DataFrame:
    return cg.categorize(v.assets(spark, sf))


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return v.assets(spark, sf).select("asset_id", lab.parse_labels("labels_json").alias("labels"))


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    exploded = v.events(spark, sf).select(
        F.explode(v.labels_of(F.col("event_id"))["text"]).alias("label")
    )
    return exploded.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Slices:
    """The events in equal slices of their order. ``run`` lets a slice arrive, in as many files as there are tasks, and takes it through
    the stream, which goes on from its checkpoint each time; ``rows`` is the stream of them."""

    spark: SparkSession
    parts: DataFrame
    total: int
    files: int
    folder: str

    @property
    def rows(self) -> DataFrame:
        return ingest.read_new_files(self.spark, self.folder, EVENTS)

    def run(self, start: Callable[[], DataStreamWriter | None]) -> None:
        for k in range(self.files):
            low, high = self.total * k // self.files, self.total * (k + 1) // self.files
            self.parts.filter((F.col("_n") > low) & (F.col("_n") <= high)).drop("_n").write.mode("append").parquet(self.folder)
            writer = start()
            if writer is not None:
                ingest.run_available(writer)


def event_slices(spark: SparkSession, sf: str, files: int = 6, order: Sequence[str] = ("event_id",)) -> Slices:
    folder = run_folder(spark, "event-files")
    parts = cut_lineage(number_sorted(v.table(spark, sf, "events").orderBy(*order), "_n"))
    v.table(spark, sf, "events").limit(0).write.parquet(folder)
    return Slices(spark, parts, parts.count(), files, folder)


def asset_slices(spark: SparkSession, sf: str, files: int = 1) -> tuple[Slices, DataFrame]:
    """Slices in time order, and the stream of assets that they make."""
    slices = event_slices(spark, sf, files, ["ts", "event_id"])
    n_vectors = v.table(spark, sf, "embeddings").count()
    return slices, v.project_assets(slices.rows, v.embedding_hashes(spark, sf), n_vectors)


def document_images(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the images of the assets with their number; the other assets have no image."""
    docs = v.table(spark, sf, "documents")
    return docs.select(v.asset_key(F.col("doc_id")).alias("asset_id"), F.encode("text", "UTF-8").alias("content"))


def ranked(df: DataFrame, name: str = "rank") -> DataFrame:
    """The rows with their place in the order in which the operator returns them."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def positioned(df: DataFrame) -> DataFrame:
    """The same for results of any size: sorted partitions keep their order when they are stored."""
    return number_sorted(df, "rank")


def collected_moves(spark: SparkSession, sf: str) -> DataFrame:
    collects = v.review_events(spark, sf).filter(
        (F.col("action") == "collect") & F.col("asset_id").isNotNull()
    )
    return collects.select(F.lit("favourites").alias("album_id"), "asset_id").distinct()


# Sources and catalog writes


@query
def scan_media(spark, sf):
    rows = review.scan_media(v.media_listing(spark, sf))
    return positioned(rows.select("asset_id", "creation_time", "width", "height"))


@query
def scan_media_albums(spark, sf):
    rows = review.scan_media(
        v.media_listing(spark, sf), "photo", v.album_assets(spark, sf), ["alb1", "alb4"]
    )
    return rows.select("asset_id", "creation_time")


def _add_to_listing(rows: DataFrame, folder: str) -> None:
    """Files that each cover a range of times, of a bounded number of rows, since a task holds a file."""
    laid = rows.select(*[field.split()[0] for field in MEDIA_LISTING.split(", ")])
    ordered = laid.repartitionByRange(*pages.ORDER).sortWithinPartitions(*pages.ORDER)
    ordered.write.mode("append").option("maxRecordsPerFile", 200_000).parquet(folder)


def _paged(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A listing folder under the name of a data source."""
    folder = run_folder(spark, "listing")
    _add_to_listing(rows, folder)
    pages.register_listing(spark, name, pages.FolderListing(folder))
    return folder


@query
def scan_media_pages(spark, sf):
    """The photos of the listing, read page by page."""
    _paged(spark, v.media_listing(spark, sf), "listing_pages")
    paged = spark.read.format("listing_pages").load()
    return paged.filter("media_type = 'photo'").select("asset_id", "creation_time", "width", "height")


@query
def stream_media_pages(spark, sf):
    """The same as a stream that stops and goes on when newer entries have come."""
    rows = v.media_listing(spark, sf)
    middle = rows.agg(F.floor((F.min("creation_time") + F.max("creation_time")) / 2)).first()[0] or 0
    folder, out = _paged(spark, rows.filter(F.col("creation_time") <= middle), "listing_stream"), run_folder(spark, "stream")
    for later in (None, rows.filter(F.col("creation_time") > middle)):
        if later is not None:
            _add_to_listing(later, folder)
        found = spark.readStream.format("listing_stream").load().filter("media_type = 'photo'")
        ingest.run_available(found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").select("asset_id", "creation_time", "width", "height")


@query
def file_signature(spark, sf):
    return listing(spark, sf).select("asset_id", "file_signature")


def _synced(spark, sf):
    return cat.sync_catalog(v.assets(spark, sf), listing(spark, sf, "photo"), now())


@query
def sync_catalog(spark, sf):
    return _synced(spark, sf).select(
        "asset_id", "taken_at", "width", "file_signature", "status", "updated_at", "action"
    )


@query
def join_sync(spark, sf):
    return _synced(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def _updates(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        v.asset_key(F.col("user_id") * 3).alias("asset_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "view", (F.col("event_id") % 500).cast("int")).alias("width"),
        F.when(kind == "click", F.col("value")).alias("blur_score"),
        F.when(kind == "error", ERROR).alias("status"),
    )


_UPSERTED = ["asset_id", "width", "blur_score", "status", "phash", "updated_at"]


@query
def upsert_coalesce(spark, sf):
    rows = cat.upsert_coalesce(v.assets(spark, sf), _updates(v.events(spark, sf)), "seq", now())
    return rows.select(*_UPSERTED)


@query
def insert_or_replace(spark, sf):
    incoming = v.events(spark, sf).select(
        F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("group_id"),
        v.asset_key(F.col("event_id") % 300).alias("asset_id"),
        (F.col("event_id") % 15).cast("int").alias("distance"),
        "event_id",
    )
    return cat.insert_or_replace(
        v.dup_members(spark, sf), incoming, ["group_id", "asset_id"], "event_id"
    )


@query
def meta_replace(spark, sf):
    meta = spark.createDataFrame(
        [("global_algo_version", "1"), ("scan_cursor_taken_at", "5")], "key string, value string"
    )
    return cat.replace_cursor(meta, v.assets(spark, sf))


def _results(spark, sf):
    """Results for the pending assets; those without a document are errors."""
    return quality.features_of(cat.pending(v.assets(spark, sf)), document_images(spark, sf))


@query
def mark_results(spark, sf):
    return cat.mark_results(v.assets(spark, sf), _results(spark, sf), 5, now()).select(
        "asset_id", r6("blur_score"), "phash", "status", "error_message", "algo_version", "updated_at"
    )


@query
def mark_done(spark, sf):
    done = _results(spark, sf).filter("error_message IS NULL")
    return done.select(
        "asset_id", r6("blur_score"), "mean_luma", "phash", F.lit(DONE).alias("status")
    )


@query
def mark_error(spark, sf):
    return _results(spark, sf).filter("error_message IS NOT NULL").select(
        "asset_id", F.lit(ERROR).alias("status"), "error_message"
    )


@query
def scan(spark, sf):
    """A whole scan; documents are the images of the assets with their number."""
    done = scanning.scan(
        v.assets(spark, sf), listing(spark, sf, "photo"), document_images(spark, sf), 3, now(), v.detections(spark, sf)
    )
    return done.catalog.select(
        "asset_id", "status", r6("blur_score"), "phash", "algo_version", "face_count", "error_message",
        (F.col("labels_json").isNotNull()).alias("has_labels"),
    )


def _plugged_features(images: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def size(content: pd.Series) -> pd.Series:
        return content.map(len).astype(float)

    return images.withColumns({"blur_score": size("content"), "mean_luma": F.lit(9.0), "phash": F.lit("00000000000000ff")})


def _plugged_labels(images: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def kind(content: pd.Series) -> pd.Series:
        return content.map(lambda c: "odd" if len(c) % 2 else "even")

    label = F.struct(kind("content").alias("text"), F.lit(0.9).alias("confidence"))
    return images.select("asset_id", F.array(label).alias("labels"), F.lit(None).cast(f"array<{FACE}>").alias("faces"))


@query
def scan_plugged(spark, sf):
    """A scan of what is pending with models given as pandas UDFs."""
    done = scanning.scan_pending(
        v.assets(spark, sf), document_images(spark, sf), 3, now(), features_fn=_plugged_features, labels_fn=_plugged_labels
    )
    return done.filter(F.col("algo_version") == 3).select(
        "asset_id", "status", "blur_score", "phash", F.get(lab.parse_labels("labels_json"), F.lit(0))["text"].alias("label")
    )


@query
def pending_images(spark, sf):
    """Features of the pending assets alone, whose ids reach the images as a Bloom filter."""
    todo = cat.pending(v.assets(spark, sf)).select("asset_id")
    return quality.features_of(todo, document_images(spark, sf), few=0).select("asset_id", r6("blur_score"), "phash", "error_message")


@query
def sink(spark, sf):
    """A report that was written and read back."""
    folder = run_folder(spark, "report")
    media.write_report(_in_libraries(v.assets(spark, sf)).transform(quality.blurry_static), folder)
    return spark.read.parquet(folder).select("library_id", "asset_id", "blur_score", "mean_luma")


@query
def album_list(spark, sf):
    bridge = v.album_assets(spark, sf)
    titles = bridge.select("album_id").distinct()
    empty = titles.select(F.lit("alb_empty").alias("album_id")).distinct()
    return review.album_list(titles.unionAll(empty), bridge).select("album_id", "asset_count")


@query
def album_move(spark, sf):
    moves = collected_moves(spark, sf)
    return review.album_move(v.album_assets(spark, sf), v.media_listing(spark, sf), moves)[0]


@query
def album_move_listing(spark, sf):
    moves = collected_moves(spark, sf)
    left = review.album_move(v.album_assets(spark, sf), v.media_listing(spark, sf), moves)[1]
    return left.select("asset_id", "media_type")


@query
def load_label_vocab(spark, sf):
    return document_lines(spark, sf)


@query
def load_translations(spark, sf):
    base = v.table(spark, sf, "part").select(
        F.format_string('  "%s": "%s",', F.lower("p_name"), F.col("p_brand")).alias("value")
    )
    return vocabulary.merge_translations(
        vocabulary.translation_lines(base), vocabulary.builtin_overrides(spark)
    )


# Projections and filters


@query
def lookup_by_key(spark, sf):
    return cat.lookup(v.face_instances(spark, sf), "face_id", ["f1", "f7", "f30"]).select(
        "instance_id", "face_id", "asset_id", "confidence"
    )


@query
def lookup_by_table(spark, sf):
    return cat.lookup(v.assets(spark, sf), "asset_id", v.face_instances(spark, sf)).select(
        "asset_id", "taken_at", "status"
    )


@query
def group_of_asset(spark, sf):
    return cat.group_of_asset(v.dup_members(spark, sf))


@query
def pending_filter(spark, sf):
    return cat.pending(v.assets(spark, sf)).select("asset_id", "taken_at")


@query
def blurry_static(spark, sf):
    return quality.blurry_static(v.assets(spark, sf))


@query
def blurry_static_top(spark, sf):
    """The report with its own length."""
    return ranked(quality.blurry_static(v.assets(spark, sf), limit=BLUR_REPORT_ROWS))


@query
def blurry_adaptive(spark, sf):
    return quality.detect_blur(v.assets(spark, sf))


@query
def blur_score_only(spark, sf):
    return quality.blur_score_only(v.content(spark, sf)).select(
        "asset_id", r6("blur_score"), "mean_luma"
    )


@query
def valid_labels(spark, sf):
    kept = lab.valid_labels("labels")["text"]
    return labeled(spark, sf).select("asset_id", joined(kept))


@query
def top_labels(spark, sf):
    top = labeled(spark, sf).select("asset_id", lab.top_labels("labels", MAX_LABELS).alias("top"))
    return top.filter(F.size("top") > 0).select("asset_id", joined(F.col("top.text")))


@query
def faces_min_size(spark, sf):
    large = lab.faces_min_size("faces", "width")
    return v.detections(spark, sf).select(
        "asset_id", F.when(large.isNotNull(), F.size(large)).alias("large_faces")
    )


@query
def context_disqualified(spark, sf):
    return labeled(spark, sf).select(
        "asset_id", lab.context_disqualified("labels").alias("disqualified")
    )


@query
def people_disqualified(spark, sf):
    return labeled(spark, sf).select(
        "asset_id", lab.people_disqualified("labels").alias("disqualified")
    )


@query
def valid_face_count(spark, sf):
    count = lab.valid_face_count("faces", v.labels_of(F.col("event_id")), "width")
    rows = v.detections(spark, sf).withColumn(
        "event_id", F.substring("asset_id", 2, 9).cast("bigint")
    )
    return rows.select("asset_id", count.alias("face_count"))


@query
def is_screenshot(spark, sf):
    return labeled(spark, sf).select("asset_id", lab.is_screenshot("labels").alias("screenshot"))


@query
def people_assets(spark, sf):
    return cg.people_assets(v.assets(spark, sf)).select("asset_id", "taken_at", "face_count")


@query
def people_assets_top(spark, sf):
    newest = cg.people_assets(v.assets(spark, sf), 200)
    return ranked(newest.select("asset_id", "taken_at", "face_count"))


@query
def labeled_assets(spark, sf):
    return cg.labeled_assets(v.assets(spark, sf)).select("asset_id", "taken_at")


@query
def labeled_assets_top(spark, sf):
    return cg.labeled_assets(v.assets(spark, sf), 5000).select("asset_id", "taken_at")


@query
def reset_outdated(spark, sf):
    return cat.reset_outdated(v.assets(spark, sf), 3, now()).select("asset_id", "status", "updated_at")


@query
def count_outdated(spark, sf):
    return cat.count_outdated(v.assets(spark, sf), 3)


@query
def reset_all(spark, sf):
    return cat.reset_all(v.assets(spark, sf), now()).select(
        "asset_id", "status", "blur_score", "phash", "algo_version", "face_count", "labels_json",
        "error_message", "updated_at",
    )


def _reset(spark, sf):
    cursor = cat.replace_cursor(spark.createDataFrame([("global_algo_version", "1")], "key string, value string"), v.assets(spark, sf))
    return cat.reset_library(v.assets(spark, sf), v.dup_groups(spark, sf), v.dup_members(spark, sf), cursor, now())


@query
def reset_all_rows(spark, sf):
    """What a fresh start leaves in each of the four tables."""
    done = _reset(spark, sf)
    counts = [
        getattr(done, name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        for name in ("catalog", "groups", "members", "meta")
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def center_crop_rect(spark, sf):
    x, y, size = img.center_crop("width", "height")
    return v.assets(spark, sf).select(
        "asset_id", x.alias("origin_x"), y.alias("origin_y"), size.alias("size")
    )


def _hash_pairs(spark, sf):
    number = F.substring("asset_id", 2, 9).cast("bigint")
    rows = v.assets(spark, sf).select("asset_id", number.alias("n"), "phash")
    nxt = rows.select((F.col("n") - 1).alias("n"), F.col("phash").alias("other"))
    return rows.join(nxt, "n")


@query
def hash_similar(spark, sf):
    return _hash_pairs(spark, sf).select(
        "asset_id", img.are_similar("phash", "other").alias("similar")
    )


# Joins


@query
def find_similar(spark, sf):
    assets = v.assets(spark, sf)
    return similarity.find_similar(assets, assets)


@query
def group_members(spark, sf):
    return groups.group_members(v.dup_members(spark, sf))


@query
def group_assets(spark, sf):
    return groups.group_assets(
        v.dup_groups(spark, sf), v.dup_members(spark, sf), v.assets(spark, sf)
    ).select("group_id", "asset_id", "taken_at", "phash")


@query
def live_semi(spark, sf):
    report = quality.blurry_static(v.assets(spark, sf))
    return quality.live_only(report, v.media_listing(spark, sf)).select("asset_id", "blur_score", "uri")


@query
def anti_processed(spark, sf):
    return review.anti_processed(v.media_listing(spark, sf), processed(spark, sf)).select(
        "asset_id", "media_type"
    )


@query
def anti_categorized(spark, sf):
    return cg.anti_categorized(v.assets(spark, sf), categorized(spark, sf))


@query
def album_restrict(spark, sf):
    return review.album_restrict(
        v.media_listing(spark, sf), v.album_assets(spark, sf), ["alb1", "alb4", "alb6"]
    ).select("asset_id", "album_id", "creation_time")


@query
def label_index_join(spark, sf):
    filled = cg.index_labels(v.detections(spark, sf), vocabulary_table(spark))
    return filled.select("asset_id", joined(F.col("labels.text")))


@query
def translate_join(spark, sf):
    picked = labeled(spark, sf).select("asset_id", lab.pick_label("labels")["label"].alias("label"))
    return cg.translate(
        picked.filter("label IS NOT NULL"), "label", "title", "zh", vocabulary.builtin_overrides(spark)
    )


@query
def representative_uri(spark, sf):
    return groups.representative_uri(
        v.dup_groups(spark, sf), v.dup_members(spark, sf), v.media_listing(spark, sf)
    ).select("group_id", "representative_uri", "member_count")


# Duplicate grouping


@query
def dup_edges(spark, sf):
    return similarity.dup_edges(v.assets(spark, sf))


@query
def dup_groups(spark, sf):
    return similarity.dup_groups(v.assets(spark, sf))


def _chains(spark, sf):
    """Every group but each fourth is merged into the one before it, so 3 goes by 2 and 1 to 0."""
    number = F.substring("group_id", 2, 20).cast("int")
    return v.dup_groups(spark, sf).filter(number % 4 != 0).select(
        F.col("group_id").alias("source_id"),
        F.concat(F.lit("g"), (number - 1).cast("string")).alias("target_id"),
    )


def _merged(spark, sf):
    return groups.merge_groups(
        v.dup_groups(spark, sf), v.dup_members(spark, sf), _chains(spark, sf)
    )


@query
def merge_groups(spark, sf):
    return _merged(spark, sf)[1]


@query
def merge_groups_left(spark, sf):
    return _merged(spark, sf)[0].select("group_id", "created_at")


@query
def delete_group(spark, sf):
    all_groups = v.dup_groups(spark, sf)
    gone = all_groups.filter("representative_asset_id IS NULL")
    return groups.delete_groups(all_groups, v.dup_members(spark, sf), gone)[1]


@query
def list_groups(spark, sf):
    return positioned(groups.list_groups(v.dup_groups(spark, sf)))


# Aggregations


@query
def status_counts(spark, sf):
    return cat.status_counts(v.assets(spark, sf))


@query
def face_statistics(spark, sf):
    return faces.face_statistics(v.face_groups(spark, sf))


@query
def face_group_counts(spark, sf):
    return faces.face_group_counts(v.face_instances(spark, sf))


@query
def face_cluster_assign(spark, sf):
    all_groups = v.face_groups(spark, sf)
    clusters = all_groups.filter("photo_count > 60").select(
        "face_id", (F.col("photo_count") % 4).cast("int").alias("cluster_id")
    )
    return faces.face_cluster_assign(all_groups, clusters).select("face_id", "cluster_id")


@query
def list_face_groups(spark, sf):
    return faces.list_face_groups(v.face_groups(spark, sf)).select(
        "face_id", "photo_count", "created_at"
    )


@query
def score_assets(spark, sf):
    return groups.score_assets(v.assets(spark, sf)).select(
        "asset_id", r6("resolution"), r6("sharpness"), r6("lighting"), r6("score")
    )


@query
def best_shot(spark, sf):
    assets = v.assets(spark, sf)
    best = groups.best_shot(similarity.dup_groups(assets), assets)
    return best.select("group_id", "best_asset_id", r6("score"))


@query
def best_shot_changes(spark, sf):
    return groups.count_best_shot_changes(
        v.dup_groups(spark, sf), v.dup_members(spark, sf), v.assets(spark, sf)
    )


@query
def group_summary(spark, sf):
    return positioned(summary(spark, sf, SimilarityConfig()))


@query
def group_summary_members(spark, sf):
    with_best, members = _grouped(spark, sf, SimilarityConfig())
    rows = groups.summary_members(with_best, members, v.media_listing(spark, sf))
    return rows.select("group_id", "asset_id", "member_rank")


def _grouped(spark: SparkSession, sf: str, config: SimilarityConfig) -> tuple[DataFrame, DataFrame]:
    assets = v.assets(spark, sf)
    members = cut_lineage(similarity.dup_groups(assets, config))
    made = groups.groups_of(members, now())
    return groups.update_best_shots(made, members, assets).drop("changed"), members


def summary(spark: SparkSession, sf: str, config: SimilarityConfig) -> DataFrame:
    """From the catalog to the report of near-duplicate groups with their best shots."""
    with_best, members = _grouped(spark, sf, config)
    report = groups.group_summary(with_best, members, v.media_listing(spark, sf))
    return report.select("group_id", "member_count", "best_asset_id", "representative_uri")


@query
def category_rollup(spark, sf):
    return cg.category_rollup(categorized(spark, sf))


@query
def people_rollup(spark, sf):
    return cg.people_rollup(v.assets(spark, sf))


@query
def uncategorized_summary(spark, sf):
    return cg.uncategorized_summary(v.assets(spark, sf), categorized(spark, sf))


@query
def total_counts(spark, sf):
    return review.total_counts(v.media_listing(spark, sf))


@query
def review_progress(spark, sf):
    return review.review_progress(v.media_listing(spark, sf), state(spark, sf))


@query
def remaining_after_delete(spark, sf):
    deleted = v.review_events(spark, sf).filter(
        F.col("action").isin("delete", "trash") & F.col("asset_id").isNotNull()
    )
    return groups.remaining_after_delete(v.dup_members(spark, sf), deleted)


@query
def vocab_duplicates(spark, sf):
    return vocabulary.vocab_duplicates(document_lines(spark, sf))


# Windows


@query
def topk_candidates(spark, sf):
    assets = v.assets(spark, sf)
    every = SimilarityConfig(similar_threshold=65)
    return (
        similarity.find_similar(assets, assets, every)
        .groupBy("target_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("recency").alias("newest_match"))
    )


@query
def prev9_frame(spark, sf):
    return similarity.count_compared(v.assets(spark, sf))


@query
def best_rank(spark, sf):
    return groups.best_rank(v.dup_members(spark, sf), v.assets(spark, sf)).select(
        "group_id", "asset_id", "best_rank"
    )


@query
def scan_batches(spark, sf):
    return cat.scan_batches(v.assets(spark, sf)).select("asset_id", "batch")


@query
def per_album_top_n(spark, sf):
    return review.per_album_top_n(v.media_listing(spark, sf), v.album_assets(spark, sf), 500).select(
        "album_id", "asset_id", "album_rank"
    )


@query
def failure_streak(spark, sf):
    return review.failure_streak(v.ml_attempts(spark, sf)).select(
        "session_id", "seq", "failed", "disabled"
    )


@query
def dedupe_keep_first(spark, sf):
    tags = v.table(spark, sf, "pages").select(
        "page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("html")
    )
    lines = vocabulary.number_lines(tags, "html", ["page_id"])
    return vocabulary.dedupe_keep_first(lines, ["page_id", "label"], "idx")


# Sorts, limits, sampling


@query
def keyset_page(spark, sf):
    return ranked(cat.keyset_page(v.assets(spark, sf), *CURSOR))


@query
def keyset_first_page(spark, sf):
    return ranked(cat.keyset_page(v.assets(spark, sf)))


def _batch(spark, sf, count, seen=None, **options):
    rows = review.review_batch(
        v.media_listing(spark, sf), v.album_assets(spark, sf), processed(spark, sf) if seen is None else seen, count, **options
    )
    return ranked(rows)


@query
def review_batch(spark, sf):
    return _batch(spark, sf, 30, order="newest", album_ids=["alb2", "alb5"])


@query
def review_batch_capped(spark, sf):
    """With the source limit of the review screen, which takes reviewed assets into account."""
    return _batch(spark, sf, 30, order="newest", album_ids=["alb2", "alb5"], source_cap=PHOTO_SOURCE_CAP)


@query
def review_batch_reviewed(spark, sf):
    """The newest 600 photos have been reviewed; the batch goes on behind them."""
    photos = review.scan_media(v.media_listing(spark, sf))
    newest = photos.orderBy(F.desc("creation_time"), F.desc("asset_id")).limit(600).select("asset_id")
    return _batch(spark, sf, 30, newest, order="newest").select("asset_id", "creation_time", "rank")


@query
def review_batch_oldest(spark, sf):
    return _batch(spark, sf, 20, media_type="video", order="oldest").select("asset_id", "creation_time", "rank")


@query
def review_batch_random(spark, sf):
    return _batch(spark, sf, 30, seed=7).select("asset_id", "creation_time", "rank")


@query
def shuffle(spark, sf):
    return positioned(review.shuffle(v.media_listing(spark, sf), 7).select("asset_id"))


@query
def processed_last(spark, sf):
    all_groups = v.dup_groups(spark, sf)
    done = all_groups.filter("best_asset_id IS NULL")
    return positioned(groups.processed_last(all_groups, done).select("group_id", "created_at", "processed"))


@query
def thumb_topn(spark, sf):
    preview = review.queue_preview(state(spark, sf))
    return preview.withColumn("shown", F.array_join("shown", "|"))


@query
def group_thumbs(spark, sf):
    shown = groups.first_members(v.dup_members(spark, sf), 4)
    return shown.withColumn("shown", F.array_join("shown", "|"))


# Set operations


@query
def union_albums(spark, sf):
    return review.union_albums(
        v.media_listing(spark, sf), v.album_assets(spark, sf), ["alb0", "alb3"]
    )


@query
def union_albums_distinct(spark, sf):
    return review.union_albums(
        v.media_listing(spark, sf), v.album_assets(spark, sf), ["alb0", "alb3"], distinct=True
    )


@query
def people_merge(spark, sf):
    return cg.people_merge(categorized(spark, sf))


@query
def uncategorized(spark, sf):
    return cg.uncategorized(categorized(spark, sf))


@query
def pending_bucket(spark, sf):
    assets = v.assets(spark, sf)
    return cg.with_pending_bucket(cg.category_rollup(cg.categorize(assets)), assets)


# Functions


@query
def hamming64(spark, sf):
    return _hash_pairs(spark, sf).select(
        "asset_id", img.hamming64("phash", "other").alias("distance")
    )


@query
def mean_luma(spark, sf):
    return v.content(spark, sf).select("asset_id", img.mean_luma("content").alias("mean_luma"))


@query
def laplacian_var(spark, sf):
    return v.content(spark, sf).select(
        "asset_id", F.round(img.laplacian_var("content"), 6).alias("blur_score")
    )


@query
def dhash64(spark, sf):
    return v.content(spark, sf).select("asset_id", img.dhash64("content").alias("phash"))


@query
def image_features(spark, sf):
    return quality.image_features(v.content(spark, sf)).select(
        "asset_id", r6("blur_score"), "mean_luma", "phash"
    )


@query
def category_group(spark, sf):
    return label_counts(spark, sf).withColumn("category_group", lab.category_group("label"))


@query
def pick_label(spark, sf):
    picked = labeled(spark, sf).select("asset_id", lab.pick_label("labels").alias("p"))
    return picked.select(
        "asset_id", F.col("p.group").alias("pick_group"), F.col("p.label").alias("pick_label")
    )


@query
def translate_label(spark, sf):
    table = vocabulary.builtin_overrides(spark)
    return cg.translate(label_counts(spark, sf), "label", "title", "zh", table)


@query
def localize(spark, sf):
    docs = v.table(spark, sf, "documents")
    english = F.when(F.col("lang") == "en", "{source}: {n} of {n}")
    translated = F.when(F.col("lang") == "de", "{source} ({n})")
    text = lab.localize(
        translated, english, F.lit("settings_progress"), {"source": "source", "n": "n_chars"}
    )
    return docs.select("doc_id", text.alias("shown"))


@query
def parse_labels(spark, sf):
    each = labeled(spark, sf).select("asset_id", F.posexplode("labels").alias("i", "x"))
    return each.select("asset_id", "i", F.col("x.text").alias("text"), F.col("x.confidence").alias("confidence"))


@query
def serialize_labels(spark, sf):
    made = lab.serialize_labels(v.labels_of(F.col("event_id")))
    return v.events(spark, sf).select(
        v.asset_key(F.col("event_id")).alias("asset_id"), made.alias("labels_json")
    )


@query
def bbox_json(spark, sf):
    return v.face_instances(spark, sf).select(
        "instance_id", lab.bbox_json("bounding_box").alias("bounding_box")
    )


@query
def detection_to_face(spark, sf):
    box = F.col("bounding_box")
    frame = F.struct(
        F.struct(box["x"].alias("x"), box["y"].alias("y")).alias("origin"),
        F.struct(box["width"].alias("x"), box["height"].alias("y")).alias("size"),
    )
    made = v.face_instances(spark, sf).select(
        "instance_id", lab.detection_to_face(frame).alias("face")
    )
    return made.select("instance_id", "face.bounding_box.*", "face.confidence")


@query
def date_string(spark, sf):
    return v.media_listing(spark, sf).select(
        "asset_id", lab.date_string("creation_time").alias("shown")
    )


@query
def group_id(spark, sf):
    return similarity.dup_groups(v.assets(spark, sf)).select("group_id").distinct()


@query
def categorize(spark, sf):
    return categorized(spark, sf).select("asset_id", "kind", "category", "from_face")


@query
def categorize_limited(spark, sf):
    """With the report's own limits on both inputs."""
    return cg.categorize(v.assets(spark, sf), people_limit=200, labeled_limit=5000).select(
        "asset_id", "kind", "category", "from_face"
    )


# Streams: run over what is there, then read the result


@query
def stream_ingest(spark, sf):
    folder = run_folder(spark, "stream")
    # A pattern, since the table may be one file, which a stream doesn't take as its folder, or a folder of many.
    docs = ingest.read_new_files(spark, f"{sf}/documents.parque[t]", DOCUMENTS)
    images = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("asset_id"),
        F.encode("text", "UTF-8").alias("content"),
    )
    ingest.run_available(ingest.stream_ingest(images, folder))
    return spark.read.schema(ingest.scan_results(images).schema).parquet(f"{folder}/results").select(
        "asset_id", r6("blur_score"), "mean_luma", "phash", "status"
    )


@query
def stream_dup_groups(spark, sf):
    return _group_stream(spark, sf).members(spark).select("group_id", "asset_id", "distance_to_parent")


@query
def stream_best_shot(spark, sf):
    return _group_stream(spark, sf).best(spark).select("group_id", "best_asset_id", r6("score"))


def _group_stream(spark, sf):
    """Over several slices in time order, so that groups go on from batch to batch."""
    stream = GroupStream(run_folder(spark, "stream"))
    slices, assets = asset_slices(spark, sf, 3)
    slices.run(lambda: stream.start(assets))
    return stream


def _in_libraries(assets: DataFrame) -> DataFrame:
    """The assets dealt to five libraries, so that neighbours in time share one."""
    number = F.substring("asset_id", 2, 9).cast("bigint")
    return assets.withColumn("library_id", F.concat(F.lit("L"), (F.floor(number / 40) % 5).cast("string")))


def _keyed_groups(spark, sf):
    stream = KeyedGroups(run_folder(spark, "stream"))
    slices, assets = asset_slices(spark, sf, 6)
    slices.run(lambda: stream.start(_in_libraries(assets)))
    return stream


@query
def stream_keyed_groups(spark, sf):
    """Groups of several libraries with their state by key."""
    return _keyed_groups(spark, sf).members(spark).select("library_id", "asset_id", "representative_asset_id", "distance_to_parent")


@query
def stream_keyed_best(spark, sf):
    return _keyed_groups(spark, sf).best(spark).select("library_id", "group_id", "best_asset_id", r6("score"))


def _regrouped(spark, sf):
    """A catalog in which some assets are missing, lie elsewhere in time, look different or wait for their scan; then all as they are."""
    table = GroupTable(run_folder(spark, "groups"))
    assets = v.assets(spark, sf)
    number = F.substring("asset_id", 2, 9).cast("bigint")
    kind = number % 50
    before = assets.filter(kind != 3).withColumns({
        "taken_at": F.when(kind == 7, F.col("taken_at") + 86_400_000).otherwise(F.col("taken_at")),
        "phash": F.when(kind == 11, F.lit("00000000000000ff")).otherwise(F.col("phash")),
        "status": F.when(kind == 19, PENDING).when(kind == 23, DONE).otherwise(F.col("status")),
    })
    table.first_run(before)
    return table, assets.filter(kind.isin(3, 7, 11, 19, 23)), number


@query
def stream_regroup(spark, sf):
    """Late, changed and reset assets in two batches; the groups are those of the catalog as it then is."""
    table, changes, number = _regrouped(spark, sf)
    folder = run_folder(spark, "changes")
    for half in range(2):
        changes.filter(F.floor(number / 50) % 2 == half).write.mode("append").parquet(folder)
        ingest.run_available(table.start(ingest.read_new_files(spark, folder, changes._jdf.schema().toDDL())))
    return table.members(spark).select("group_id", "asset_id", "representative_asset_id", "distance_to_parent")


@query
def stream_status(spark, sf):
    """Every asset comes twice, first as pending; counters go up and down step by step."""
    counters = StatusCounters(run_folder(spark, "stream"))
    slices, assets = asset_slices(spark, sf, 6)
    first = assets.withColumns({"status": F.lit(PENDING), "updated_at": F.col("updated_at") - 1})

    def one() -> None:
        counters.run(first.union(assets))

    slices.run(one)
    return counters.counts(spark)


@query
def stream_status_batches(spark, sf):
    """The same from the last status of each batch."""
    stream = ingest.StatusStream(run_folder(spark, "stream"))
    slices, assets = asset_slices(spark, sf, 2)
    first = assets.withColumns({"status": F.lit(PENDING), "updated_at": F.col("updated_at") - 1})
    slices.run(lambda: stream.start(first.union(assets)))
    return stream.counts(spark)


@query
def stream_upsert(spark, sf):
    """Several ordered slices; the first half is compacted before the rest is folded."""
    folder = run_folder(spark, "stream")
    slices = event_slices(spark, sf)
    slices.run(lambda: stream_catalog.stream_upsert(_updates(slices.rows), folder))
    log = spark.read.parquet(f"{folder}/log")
    table = stream_catalog.CompactedCatalog(f"{folder}/catalog")
    table.start(v.assets(spark, sf))
    half = log.agg(F.max("seq")).first()[0] // 2
    table.compact(spark, log.filter(F.col("seq") <= half), now())
    return table.current(spark, log, now()).select(*_UPSERTED)


@query
def compact_buckets(spark, sf):
    """The catalog after two compactions that write the buckets named by the log, and what came after them."""
    base = v.assets(spark, sf)
    log = cut_lineage(_updates(v.events(spark, sf)))
    table = stream_catalog.BucketedCatalog(run_folder(spark, "catalog"), base.schema, buckets=16)
    table.start(base)
    last = log.agg(F.max("seq")).first()[0] or 0
    for part in (3, 2):
        table.compact(spark, log.filter(F.col("seq") <= last // part), now())
    return table.current(spark, log, now()).select(*_UPSERTED)


@query
def keyset_page_clustered(spark, sf):
    """All that a scan finds beyond its cursor, from a catalog laid out by month."""
    folder = run_folder(spark, "clustered")
    clustered.write_clustered(v.assets(spark, sf), folder)
    rows = clustered.read_clustered(spark, folder, since=CURSOR[0])
    return cat.keyset_page(rows, *CURSOR, limit=None).select("asset_id", "taken_at")


@query
def face_statistics_sketched(spark, sf):
    """Estimates from the sketches of all days beside the exact numbers."""
    groups_ = v.face_groups(spark, sf)
    sketches = cut_lineage(faces.face_sketches(groups_))
    near = faces.estimated_statistics(sketches).select(F.lit(0).alias("k"), F.col("total_faces").alias("f"), F.col("total_clusters").alias("c"))
    exact = faces.face_statistics(groups_).withColumn("k", F.lit(0))

    def close(estimate: str, exact: str) -> Column:
        return (F.abs(F.col(estimate) - F.col(exact)) <= F.col(exact) * 0.02).alias(f"{exact}_close")

    return exact.join(near, "k").select("total_faces", "total_clusters", close("f", "total_faces"), close("c", "total_clusters"))


@query
def stream_review(spark, sf):
    """State by asset in the state store."""
    stream = KeyedReview(run_folder(spark, "stream"))
    slices = event_slices(spark, sf)
    slices.run(lambda: stream.start(v.project_reviews(slices.rows)))
    return stream.state(spark)


@query
def stream_review_batches(spark, sf):
    """The same with a table of states for each batch."""
    stream = ReviewStream(run_folder(spark, "stream"))
    slices = event_slices(spark, sf, 3)
    slices.run(lambda: stream.start(v.project_reviews(slices.rows)))
    return stream.state(spark)


@query
def review_fold(spark, sf):
    return state(spark, sf)


@query
def late_assets(spark, sf):
    return cat.late_assets(v.assets(spark, sf), *CURSOR)


@query
def stream_on_time(spark, sf):
    """Every asset comes twice within the watermark and is kept once."""
    folder = run_folder(spark, "stream")
    slices, assets = asset_slices(spark, sf)
    timed = assets.filter("taken_at is not null").select("asset_id", "taken_at")
    once = ingest.on_time_assets(timed.union(timed), "1 hour").select("asset_id", "taken_at")
    writer = once.writeStream.format("parquet").option("path", f"{folder}/once")
    slices.run(lambda: writer.option("checkpointLocation", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/once")


DELAY_MS = 6 * 3_600_000


@query
def stream_arrivals(spark, sf):
    """Assets in four slices of time, every tenth twice; some are dated up to two days back, and are late where that is before the watermark."""
    stream = Arrivals(run_folder(spark, "stream"), ["asset_id"], "taken_at", DELAY_MS)
    slices, assets = asset_slices(spark, sf, 4)
    number = F.substring("asset_id", 2, 9).cast("bigint")
    back = F.when(number % 9 == 4, F.col("taken_at") - 86_400_000 * (number % 3)).otherwise(F.col("taken_at"))
    rows = assets.select("asset_id", back.alias("taken_at"))
    slices.run(lambda: stream.start(rows.union(rows.filter(number % 10 == 0))))
    return stream.rows(spark).select("asset_id", "taken_at", "arrival")


@query
def error_isolation(spark, sf):
    return quality.features_of(v.assets(spark, sf), document_images(spark, sf)).select("asset_id", "error_message")
