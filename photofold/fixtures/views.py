"""Media tables derived from ``events``, ``embeddings``, ``documents`` and ``pages``.

Each view is a whole-table projection of the given tables; ``oracles.VIEWS`` holds
the same formulas as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photofold.plans.ordering import spread

# Labels of the derived detections (24 entries).
VOCABULARY = [
    "tabby", "tiger cat", "Siamese cat", "golden retriever", "Cardigan", "prairie dog",
    "hotdog", "bald eagle", "robin", "web site", "monitor", "menu",
    "comic book", "groom", "kimono", "bow tie", "cellular telephone", "coffee mug",
    "seashore", "umbrella", "Egyptian cat", "screenshot", "carton", "volcano",
]
GLOBAL_ACTIONS = {
    100: ("photo", "confirm"),
    200: ("photo", "batch_reset"),
    300: ("photo", "load"),
    400: ("photo", "progress_reset"),
    500: ("video", "confirm"),
    600: ("video", "confirm_failed"),
    700: ("video", "progress_reset"),
}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _id() -> Column:
    return F.col("event_id")


def asset_key(number: Column, prefix: str = "a") -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 9, "0"))


def _millis() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _seconds() -> Column:
    return F.floor(_millis() / 1000)


def _size() -> Column:
    return (_id() * 7919) % 5_000_000


def embedding_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign of each of the 64 coordinates, lowest bit first."""
    bit = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(
            F.when(
                F.get("embedding", i) < 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
            ).otherwise(F.lit(0).cast("bigint"))
        ),
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", bit.alias("sign_bits"))


def labels_of(number: Column) -> Column:
    """0 to 5 labels; NULL instead of none."""
    words = F.array(*[F.lit(w) for w in VOCABULARY])
    made = F.transform(
        F.sequence(F.lit(0), (number % 6).cast("int") - 1),
        lambda i: F.struct(
            F.get(words, ((number * 7 + i * 5) % len(VOCABULARY)).cast("int")).alias("text"),
            (((number * 31 + i * 17) % 100) / 100.0).alias("confidence"),
        ),
    )
    return F.when(number % 6 > 0, made)


def project_assets(rows: DataFrame, hashes: DataFrame, n_vectors: int) -> DataFrame:
    """Rows of ``events`` (batch or stream) to catalog rows."""
    mixed = F.col("sign_bits").bitwiseXOR((_id() * 2654435761).bitwiseAND(F.lit(1048575)))
    joined = rows.withColumn("vec_id", F.floor(_id() / 4) % n_vectors).join(hashes, "vec_id")
    return joined.select(
        asset_key(_id()).alias("asset_id"),
        F.when(_id() % 97 != 0, _millis()).alias("taken_at"),
        F.when(_id() % 53 != 0, 640 + (_id() * 37) % 3400).cast("int").alias("width"),
        (480 + (_id() * 53) % 2600).cast("int").alias("height"),
        F.concat_ws("_", _seconds(), _size()).alias("file_signature"),
        F.when(_id() % 11 != 0, 1 + _id() % 4).cast("int").alias("algo_version"),
        (F.col("value") * 4).alias("blur_score"),
        ((_id() * 13) % 256).cast("double").alias("mean_luma"),
        F.when(_id() % 101 != 0, F.lower(F.lpad(F.hex(mixed), 16, "0"))).alias("phash"),
        F.when(_id() % 67 == 0, "not json").otherwise(F.to_json(labels_of(_id()))).alias("labels_json"),
        F.when(F.col("event_type") == "error", 2)
        .when(F.col("event_type") == "signup", 0)
        .otherwise(1)
        .alias("status"),
        F.when(F.col("event_type") == "error", "decode failed").alias("error_message"),
        _millis().alias("updated_at"),
        F.when(_id() % 41 != 0, F.when(_id() % 5 == 0, 1 + _id() % 3).otherwise(0))
        .cast("int")
        .alias("face_count"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_vectors = table(spark, sf_dir, "embeddings").count()
    rows = spread(events(spark, sf_dir))
    return project_assets(rows, embedding_hashes(spark, sf_dir), n_vectors)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detector output: labels, some without text, and faces of varying width."""
    labels = F.transform(
        labels_of(_id()),
        lambda x, i: F.struct(
            F.when((_id() + i) % 4 == 0, "").otherwise(x["text"]).alias("text"),
            ((_id() * 3 + i) % 30).cast("int").alias("index"),
            x["confidence"].alias("confidence"),
        ),
    )
    faces = F.transform(
        F.sequence(F.lit(0), (_id() % 3).cast("int")),
        lambda i: F.struct(
            F.struct(
                (i * 10).cast("double").alias("x"),
                (i * 20).cast("double").alias("y"),
                ((_id() * 17 + i * 211) % 900).cast("double").alias("width"),
                ((_id() * 19 + i * 97) % 900).cast("double").alias("height"),
            ).alias("bounding_box"),
            F.lit(0.85).alias("confidence"),
        ),
    )
    return events(spark, sf_dir).select(
        asset_key(_id()).alias("asset_id"),
        F.when(_id() % 53 != 0, 640 + (_id() * 37) % 3400).cast("int").alias("width"),
        labels.alias("labels"),
        F.when(_id() % 29 != 0, faces).alias("faces"),
    )


def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)

    def rows(src: DataFrame, prefix: str) -> DataFrame:
        key = asset_key(_id(), prefix)
        return src.select(
            key.alias("asset_id"),
            F.when(_id() % 7 == 0, "video").otherwise("photo").alias("media_type"),
            _millis().alias("creation_time"),
            (640 + (_id() * 37) % 3400).cast("int").alias("width"),
            (480 + (_id() * 53) % 2600).cast("int").alias("height"),
            F.concat(F.lit("media://"), key).alias("uri"),
            F.when(_id() % 10 != 0, F.concat(F.lit("file:///"), key)).alias("local_uri"),
            _seconds().alias("mtime"),
            (_size() + F.when(_id() % 13 == 0, 1).otherwise(0)).alias("size"),
        )

    return rows(ev.filter(_id() % 19 != 0), "a").unionAll(rows(ev.filter(_id() % 23 == 0), "n"))


def album_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    user = F.col("user_id")

    def rows(src: DataFrame, number: Column) -> DataFrame:
        return src.select(
            F.concat(F.lit("alb"), (number % 8).cast("string")).alias("album_id"),
            asset_key(_id()).alias("asset_id"),
        )

    return rows(ev, user).unionAll(rows(ev.filter(_id() % 4 == 0), user + 3))


def project_reviews(rows: DataFrame) -> DataFrame:
    """Rows of ``events`` to review actions; global actions carry no asset."""
    number = _id() % 200
    video = number % 7 == 0
    kind = F.col("event_type")
    photo_action = (
        F.when(kind == "click", "delete")
        .when(kind == "purchase", "collect")
        .when(kind == "error", "undo")
        .when(kind == "signup", "album")
        .otherwise("skip")
    )
    video_action = (
        F.when(kind.isin("click", "purchase"), "trash")
        .when(kind.isin("error", "signup"), "restore")
        .otherwise("processed")
    )
    slot = _id() % 997
    media, action = F.when(video, "video").otherwise("photo"), F.when(
        video, video_action
    ).otherwise(photo_action)
    for at, (global_media, global_action) in GLOBAL_ACTIONS.items():
        media = F.when(slot == at, global_media).otherwise(media)
        action = F.when(slot == at, global_action).otherwise(action)
    return rows.select(
        _id().alias("seq"),
        F.when(~slot.isin(*GLOBAL_ACTIONS), asset_key(number)).alias("asset_id"),
        media.alias("media_type"),
        action.alias("action"),
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_reviews(events(spark, sf_dir))


def face_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per face: user; its cluster; when and where it was first seen."""
    user = F.col("user_id")
    first = F.min(F.struct(_id(), F.col("ts")))
    return (
        events(spark, sf_dir)
        .groupBy("user_id")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("f"), user.cast("string")).alias("face_id"),
            F.when(user % 5 != 0, user % 7).cast("int").alias("cluster_id"),
            asset_key(F.col("first.event_id")).alias("first_seen_asset_id"),
            F.lit(None).cast("string").alias("representative_uri"),
            F.col("n").cast("int").alias("photo_count"),
            F.unix_millis(F.col("first.ts").cast("timestamp")).alias("created_at"),
        )
    )


def face_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .filter(_id() % 5 == 0)
        .select(
            F.concat(F.lit("i"), _id().cast("string")).alias("instance_id"),
            F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("face_id"),
            asset_key(_id()).alias("asset_id"),
            F.struct(
                F.lit(0.0).alias("x"),
                (_id() % 10).cast("double").alias("y"),
                ((_id() * 17) % 900).cast("double").alias("width"),
                ((_id() * 19) % 900).cast("double").alias("height"),
            ).alias("bounding_box"),
            F.lit(0.85).alias("confidence"),
            _millis().alias("seen_at"),
        )
    )


def ml_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        _id().alias("seq"),
        F.col("event_type").isin("error", "signup").alias("failed"),
    )


def dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made groups for the maintenance operators: one per user, processed assets only."""
    return (
        events(spark, sf_dir)
        .filter(~F.col("event_type").isin("error", "signup"))
        .select(
            F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("group_id"),
            asset_key(_id()).alias("asset_id"),
            ((_id() * 7) % 15).cast("int").alias("distance"),
        )
    )


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group per user; some without representative, some without members."""
    user = F.col("user_id")
    return (
        events(spark, sf_dir)
        .groupBy("user_id")
        .agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
        .select(
            F.concat(F.lit("g"), user.cast("string")).alias("group_id"),
            F.when(user % 9 != 0, asset_key(F.col("lo"))).alias("representative_asset_id"),
            F.when(user % 4 != 0, asset_key(F.col("hi"))).alias("best_asset_id"),
            (1_700_000_000_000 + (user % 50) * 1000).alias("created_at"),
        )
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to compute features from: all documents and pages."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("asset_id"),
        F.encode("text", "UTF-8").alias("content"),
    )
    pages = spread(table(spark, sf_dir, "pages")).select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("asset_id"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return docs.unionAll(pages)
