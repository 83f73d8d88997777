"""Labels and faces rolled up into people, object and leftover categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photofold.config import DONE
from photofold.functions.binding import let
from photofold.functions.labels import (
    capitalized,
    lookup_text,
    parse_labels,
    people_disqualified,
    pick_label,
    translate_label,
)
from photofold.operators.catalog import status_counts
from photofold.plans.hot_keys import broadcast_if_fits, first_rows, fits, salted_join
from photofold.schemas import library_keys

# A translation table up to this size is put into the plan as a map literal.
LITERAL_ROWS = 2_000

PEOPLE, OBJECT = "people", "object"
UNCATEGORIZED = {"en": "Uncategorized", "zh": "未分类"}
PROCESSING = {"en": "processing", "zh": "处理中"}


def _newest(assets: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return assets
    order = [F.desc_nulls_last("taken_at"), F.desc("asset_id")]
    return first_rows(assets, library_keys(assets), order, limit)


def people_assets(assets: DataFrame, limit: int | None = None) -> DataFrame:
    """Assets with faces, whatever their status; with a limit, the newest of each library."""
    return _newest(assets.filter(F.col("face_count") > 0), limit)


def labeled_assets(assets: DataFrame, limit: int | None = None) -> DataFrame:
    """Processed assets, with or without labels; with a limit, the newest of each library."""
    return _newest(assets.filter(F.col("status") == DONE), limit)


def index_labels(
    detections: DataFrame, vocabulary: DataFrame, text_of_missing: str = "Unknown"
) -> DataFrame:
    """Fill empty label texts from the vocabulary by index.

    A vocabulary of model size becomes an array literal, so nothing is shuffled; a larger
    one is joined label by label, with the same result. Of an index that is listed twice the
    first label in alphabetical order counts; empty arrays stay empty and NULL stays NULL.
    """
    vocabulary = vocabulary.groupBy("idx").agg(F.min("label").alias("label"))
    if fits(vocabulary, LITERAL_ROWS):
        words = {r["idx"]: r["label"] for r in vocabulary.collect()}
        by_index = F.array(*[F.lit(words.get(i)) for i in range(max(words, default=-1) + 1)])

        def text(x: Column) -> Column:
            known = F.when(x["index"] >= 0, F.get(by_index, x["index"]))
            return F.coalesce(F.nullif(x["text"], F.lit("")), known, F.lit(text_of_missing))

        return detections.withColumn(
            "labels",
            F.transform(
                "labels",
                lambda x: F.struct(text(x).alias("text"), x["confidence"].alias("confidence")),
            ),
        )
    keys = [*library_keys(detections), "asset_id"]
    exploded = detections.select(*keys, F.posexplode("labels").alias("_at", "_label")).select(
        *keys, "_at", "_label", F.col("_label.index").alias("idx")
    )
    joined = salted_join(exploded, vocabulary.select("idx", "label"), ["idx"], "left")
    text = F.coalesce(F.nullif(F.col("_label.text"), F.lit("")), "label", F.lit(text_of_missing))
    # Labels per asset are bounded by the detector, so the array per asset is, too.
    filled = joined.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "_at",
                    F.struct(
                        text.alias("text"), F.col("_label.confidence").alias("confidence")
                    ).alias("label"),
                )
            )
        ).alias("_labels")
    )
    bare = F.transform(
        F.when(F.size("labels") == 0, F.col("labels")),
        lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence")),
    )
    return (
        detections.withColumn("_empty", bare)
        .drop("labels")
        .join(filled, keys, "left")
        .withColumn("labels", F.coalesce(F.transform("_labels", lambda x: x["label"]), "_empty"))
        .drop("_labels", "_empty")
    )


def translate(
    df: DataFrame, label: str, title: str, language: str, translations: DataFrame | None = None
) -> DataFrame:
    """Add ``title``: the label in the given language. ``translations`` is (label, zh)."""
    if language != "zh" or translations is None:
        return df.withColumn(title, translate_label(label, language))
    table = translations.filter(F.col("zh") != "").groupBy("label").agg(F.max("zh").alias("zh"))
    if fits(table, LITERAL_ROWS):
        pairs = {r["label"]: r["zh"] for r in table.collect()}
        return df.withColumn(title, translate_label(label, language, pairs))
    # Translate each distinct label once, then join the titles back.
    labels = df.select(F.col(label).alias("_label")).distinct().filter(F.col("_label").isNotNull())
    text = lookup_text("_label")
    tries = labels.select(
        "_label", F.posexplode(F.concat(F.array(text), F.split(text, ","))).alias("_at", "_try")
    ).withColumn("label", lookup_text("_try"))
    titles = (
        tries.join(table, "label")
        .groupBy("_label")
        .agg(F.min_by("zh", "_at").alias("_title"))
    )
    joined = salted_join(
        df.withColumn("_label", F.col(label)), titles, ["_label"], "left"
    )
    return joined.withColumn(title, F.coalesce("_title", capitalized(label))).drop(
        "_label", "_title"
    )


def _flag_newest(assets: DataFrame, newest: DataFrame, flag: str) -> DataFrame:
    """Mark the rows of a limited report; its size is the limit, which is checked."""
    keys = [*library_keys(assets), "asset_id"]
    ids = newest.select(*keys).withColumn(flag, F.lit(True))
    return assets.join(broadcast_if_fits(ids), keys, "left").withColumn(
        flag, F.coalesce(flag, F.lit(False))
    )


def categorize(
    assets: DataFrame,
    language: str = "en",
    translations: DataFrame | None = None,
    people_limit: int | None = None,
    labeled_limit: int | None = None,
) -> DataFrame:
    """Category of every asset that belongs to a report.

    ``kind`` is people, object or NULL (processed but uncategorised); ``category`` its key;
    ``from_face`` tells face-based people from label-based ones. Without limits this is a
    single pass over the catalog; ``people_limit=200, labeled_limit=5000`` restrict the two
    inputs to the newest assets.
    """
    rows = assets.select(
        *library_keys(assets), "asset_id", "taken_at", "status", "face_count", "labels_json"
    )
    if people_limit is None:
        rows = rows.withColumn("_face", F.coalesce(F.col("face_count") > 0, F.lit(False)))
    else:
        rows = _flag_newest(rows, people_assets(assets, people_limit), "_face")
    if labeled_limit is None:
        rows = rows.withColumn("_labeled", F.col("status") == DONE)
    else:
        rows = _flag_newest(rows, labeled_assets(assets, labeled_limit), "_labeled")

    def of_face(by_face: Column, labels: Column) -> Column:
        pick = let(
            F.when(~by_face, pick_label(labels)),
            lambda p: F.struct(
                by_face.alias("from_face"), p["group"].alias("group"), p["label"].alias("label")
            ),
        )
        return F.array(F.when(by_face | F.col("_labeled"), pick))

    found = let(
        parse_labels("labels_json"),
        lambda labels: let(
            F.col("_face") & ~people_disqualified(labels), lambda face: of_face(face, labels)
        ),
    )
    # One array per asset, exploded: a later filter then works on the finished row and
    # is not pushed down as a second copy of the label logic.
    picked = rows.filter(F.col("_face") | F.col("_labeled")).select(
        *library_keys(assets),
        "asset_id",
        "taken_at",
        "face_count",
        F.explode(F.array_compact(found)).alias("_found"),
    )
    named = picked.withColumn("_name", F.col("_found.label"))
    titled = translate(named, "_name", "_title", language, translations)
    by_face, group = F.col("_found.from_face"), F.col("_found.group")
    face_key = F.when(F.col("face_count") > 1, "people_group").otherwise("people_single")
    return titled.select(
        *library_keys(assets),
        "asset_id",
        "taken_at",
        F.when(by_face | (group == "people"), PEOPLE)
        .when(F.col("_name").isNotNull(), OBJECT)
        .alias("kind"),
        F.when(by_face, face_key)
        .when(group == "people", "people_single")
        .when(F.col("_name").isNotNull(), F.col("_title"))
        .alias("category"),
        by_face.alias("from_face"),
    )


def category_rollup(categorized: DataFrame) -> DataFrame:
    """Size and cover of each category, largest first, ties by the newest member.

    The cover is the newest member; in people categories a face asset goes first.
    """
    keys = [*library_keys(categorized), "kind", "category"]
    newest = F.struct("from_face", "taken_at", "asset_id")
    return (
        categorized.filter(F.col("kind").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.max_by("asset_id", newest).alias("cover_asset_id"),
            F.max("taken_at").alias("_newest"),
        )
        .orderBy("kind", F.desc("count"), F.desc_nulls_last("_newest"), "category")
        .drop("_newest")
    )


def people_rollup(assets: DataFrame, limit: int | None = None) -> DataFrame:
    """People categories from faces alone."""
    faces = people_assets(assets, limit).filter(
        ~people_disqualified(parse_labels("labels_json"))
    )
    key = F.when(F.col("face_count") > 1, "people_group").otherwise("people_single")
    return (
        faces.groupBy(*library_keys(assets), key.alias("category"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.max_by("asset_id", F.struct("taken_at", "asset_id")).alias("cover_asset_id"),
        )
        .orderBy(F.desc("count"), "category")
    )


def people_merge(categorized: DataFrame) -> DataFrame:
    """People categories after label-inferred people joined ``people_single``."""
    return category_rollup(categorized.filter(F.col("kind") == PEOPLE)).drop("kind")


def uncategorized(categorized: DataFrame) -> DataFrame:
    """Processed assets without a category."""
    return categorized.filter(F.col("kind").isNull()).select(
        *library_keys(categorized), "asset_id", "taken_at"
    )


def anti_categorized(processed: DataFrame, categorized: DataFrame) -> DataFrame:
    """The same as a set difference, for categories that were stored earlier."""
    keys = [*library_keys(processed), "asset_id"]
    done = categorized.filter(F.col("kind").isNotNull()).select(*keys)
    return processed.filter(F.col("status") == DONE).select(*keys).join(done, keys, "left_anti")


def uncategorized_summary(
    assets: DataFrame, categorized: DataFrame, language: str = "en"
) -> DataFrame:
    """Title and size of the leftover category: uncategorised plus pending; no row if both are 0."""
    keys = library_keys(assets)
    left = (
        uncategorized(categorized)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by("asset_id", F.struct("taken_at", "asset_id")).alias("cover_asset_id"),
        )
        .withColumn("pending", F.lit(0).cast("bigint"))
    )
    waiting = status_counts(assets).select(
        *keys,
        F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("string").alias("cover_asset_id"),
        "pending",
    )
    # One row per library on each side: add them up instead of joining.
    both = (
        left.unionByName(waiting)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"),
            F.max("cover_asset_id").alias("cover_asset_id"),
        )
    )
    title = F.lit(UNCATEGORIZED[language])
    more = F.format_string(f" (+%d {PROCESSING[language]})", F.col("pending"))
    return both.filter(F.col("n") + F.col("pending") > 0).select(
        *keys,
        F.when(F.col("pending") > 0, F.concat(title, more)).otherwise(title).alias("title"),
        (F.col("n") + F.col("pending")).alias("count"),
        "cover_asset_id",
    )


def with_pending_bucket(rollup: DataFrame, assets: DataFrame, language: str = "en") -> DataFrame:
    """Object categories plus a last pseudo category for assets still being processed."""
    keys = library_keys(assets)
    name = {"en": "Processing (%d)", "zh": "处理中 (%d)"}[language]
    waiting = (
        status_counts(assets)
        .filter(F.col("pending") > 0)
        .select(
            *keys,
            F.lit("status_pending").alias("id"),
            F.format_string(name, F.col("pending")).alias("title"),
            F.col("pending").alias("count"),
            F.lit(None).cast("string").alias("cover_asset_id"),
            F.lit(1).alias("section"),
        )
    )
    rows = rollup.filter(F.col("kind") == OBJECT).select(
        *keys,
        F.concat(F.lit("obj_"), F.col("category")).alias("id"),
        F.col("category").alias("title"),
        "count",
        "cover_asset_id",
        F.lit(0).alias("section"),
    )
    return rows.unionByName(waiting).orderBy("section", F.desc("count"), "id")
