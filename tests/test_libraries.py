"""Operators on two libraries at once give what they give on each alone."""

import pytest
from pyspark.sql import functions as F

from photofold.operators import catalog, categories, faces, groups, quality, review
from photofold.plans.hot_keys import first_rows

ROWS = 60


def assets(spark, shift):
    rows = [
        (f"a{i:03d}", None if i % 11 == 0 else 1000 + (i * 7 + shift) % 40, 640, 480, 1 if i % 3 else 0, float((i * 13 + shift) % 140),
         130.0, i % 3, None)
        for i in range(ROWS)
    ]
    return spark.createDataFrame(
        rows,
        "asset_id string, taken_at bigint, width int, height int, status int, blur_score double, mean_luma double, face_count int, "
        "labels_json string",
    )


def members(spark, shift):
    rows = [(f"g{(i + shift) % 7}", f"a{i:03d}", i % 5) for i in range(ROWS)]
    return spark.createDataFrame(rows, "group_id string, asset_id string, distance int")


def face_rows(spark, shift):
    rows = [(f"f{(i + shift) % 4}", f"a{i:03d}", i + shift) for i in range(20)]
    return spark.createDataFrame(rows, "face_id string, asset_id string, seen_at bigint")


def face_groups(spark, shift):
    rows = [(f"f{i}", (i + shift) % 3 if i % 2 else None) for i in range(9)]
    return spark.createDataFrame(rows, "face_id string, cluster_id int")


def listing(spark, shift):
    rows = [(f"a{i:03d}", "photo", (i * 3 + shift) % 50) for i in range(ROWS)]
    return spark.createDataFrame(rows, "asset_id string, media_type string, creation_time bigint")


def chains(spark, shift):
    return spark.createDataFrame([("g3", "g2"), ("g2", "g1"), ("g5", f"g{shift}")], "source_id string, target_id string")


def group_ids(frame):
    return frame.select(*[c for c in ("library_id", "group_id") if c in frame.columns]).distinct()


EMPTY_META = "key string, value string"
OPERATORS = {
    "keyset_page": ([assets], lambda a: catalog.keyset_page(a, limit=7)),
    "keyset_page_after": ([assets], lambda a: catalog.keyset_page(a, 1010, "a000", 7)),
    "scan_batches": ([assets], lambda a: catalog.scan_batches(a, 5)),
    "late_assets": ([assets], lambda a: catalog.late_assets(a, 1020, "a010")),
    "replace_cursor": ([assets], lambda a: catalog.replace_cursor(
        a.limit(0).select(*[c for c in ("library_id",) if c in a.columns], F.lit("").alias("key"), F.lit("").alias("value")), a)),
    "lookup": ([assets, face_rows], lambda a, f: catalog.lookup(a, "asset_id", f)),
    "blurry": ([assets], lambda a: quality.blurry_static(a, limit=9)),
    "people": ([assets], lambda a: categories.people_assets(a, 6)),
    "labeled": ([assets], lambda a: categories.labeled_assets(a, 6)),
    "categorize": ([assets], lambda a: categories.categorize(a, people_limit=5, labeled_limit=8)),
    "face_counts": ([face_rows], faces.face_group_counts),
    "face_statistics": ([face_groups], faces.face_statistics),
    "face_clusters": ([face_groups], lambda g: faces.face_cluster_assign(g, g.filter("cluster_id = 1").withColumn("cluster_id", F.lit(8)))),
    "merge_groups": ([members, chains], lambda m, c: groups.merge_groups(group_ids(m), m, c)[1]),
    "scan_media": ([listing], lambda x: review.scan_media(x, limit=4)),
}


def rows(df, drop=()):
    columns = sorted(c for c in df.columns if c not in drop)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_two_libraries(spark, name):
    makers, operator = OPERATORS[name]
    alone = {k: operator(*[m(spark, k) for m in makers]) for k in (0, 1)}
    both = [
        m(spark, 0).withColumn("library_id", F.lit("L0")).unionByName(m(spark, 1).withColumn("library_id", F.lit("L1"))) for m in makers
    ]
    together = operator(*both)
    for k in (0, 1):
        part = together.filter(F.col("library_id") == f"L{k}")
        assert rows(part, ["library_id"]) == rows(alone[k]) != []


def test_review_batch_of_two_libraries(spark):
    both = listing(spark, 0).withColumn("library_id", F.lit("L0")).unionByName(listing(spark, 1).withColumn("library_id", F.lit("L1")))
    none = spark.createDataFrame([], "library_id string, album_id string, asset_id string")
    batch = review.review_batch(both, none, none, 5, order="newest").collect()
    assert sorted(r.library_id for r in batch) == ["L0"] * 5 + ["L1"] * 5


def test_cursors_of_libraries(spark):
    both = assets(spark, 0).withColumn("library_id", F.lit("L0")).unionByName(assets(spark, 0).withColumn("library_id", F.lit("L1")))
    cursors = spark.createDataFrame([("L1", 1020, "a010")], "library_id string, cursor_taken_at bigint, cursor_asset_id string")
    late = catalog.late_assets(both, cursors=cursors)
    assert {r.library_id for r in late.collect()} == {"L1"}
    assert rows(late, ["library_id"]) == rows(catalog.late_assets(assets(spark, 0), 1020, "a010"))


def test_chains_and_circles(spark):
    mapping = spark.createDataFrame([(f"g{k}", f"g{k + 1}") for k in range(20)] + [("x", "g7")], "source_id string, target_id string")
    assert {r.target_id for r in groups.final_targets(mapping).collect()} == {"g20"}
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "source_id string, target_id string")
    with pytest.raises(ValueError, match="circle"):
        groups.final_targets(circle)


def test_label_index_is_the_same_on_both_paths(spark, monkeypatch):
    labels = "array<struct<index:int,text:string,confidence:double>>"
    rows_ = [("a", []), ("b", None), ("c", [(0, "", 0.5), (1, "own", 0.6), (9, None, 0.1)])]
    detections = spark.createDataFrame(rows_, f"asset_id string, labels {labels}")
    vocabulary = spark.createDataFrame([(0, "zero"), (0, "also zero"), (1, "one")], "idx int, label string")
    literal = rows(categories.index_labels(detections, vocabulary))
    monkeypatch.setattr(categories, "LITERAL_ROWS", 0)
    assert rows(categories.index_labels(detections, vocabulary)) == literal
    assert literal[0] == ("a", []) and literal[1] == ("b", None)


def test_translation_is_the_same_on_both_paths(spark, monkeypatch):
    table = spark.createDataFrame([("cat", "x"), ("cat", "y"), ("dog", "z"), ("bird", "")], "label string, zh string")
    labels = spark.createDataFrame([("cat",), ("a, dog",), ("bird",), (None,)], "label string")
    literal = rows(categories.translate(labels, "label", "title", "zh", table))
    monkeypatch.setattr(categories, "LITERAL_ROWS", 0)
    assert rows(categories.translate(labels, "label", "title", "zh", table)) == literal


def test_limits_are_per_key_or_off(spark):
    df = assets(spark, 0)
    assert first_rows(df, [], [F.asc("asset_id")], None).count() == ROWS
    assert [r.asset_id for r in first_rows(df, [], [F.desc("asset_id")], 2).collect()] == ["a059", "a058"]
