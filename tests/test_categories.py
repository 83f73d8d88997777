import json
import random

import pytest

from photofold.operators import categories as cg
from photofold.operators import faces
from photofold.sources import vocabulary

SCHEMA = "asset_id string, taken_at bigint, status int, face_count int, labels_json string"


def label_json(*labels):
    return json.dumps([{"text": t, "confidence": c} for t, c in labels])


@pytest.fixture(scope="module")
def assets(spark):
    rows = [
        ("f1", 10, 1, 1, label_json(("volcano", 0.9))),
        ("f2", 11, 2, 3, None),
        ("f3", 12, 1, 1, label_json(("carton", 0.9))),
        ("f4", 13, 0, 1, "not json"),
        ("f5", 14, 2, 1, label_json(("menu", 0.9))),
        ("h1", 99, 1, 0, label_json(("groom", 0.5))),
        ("o1", 20, 1, 0, label_json(("tabby", 0.9))),
        ("o2", 21, 1, None, label_json(("Volcano", 0.5), ("tiger cat", 0.5))),
        ("o3", 22, 1, 0, label_json(("volcano", 0.9))),
        ("u1", 30, 1, 0, label_json(("volcano", 0.3))),
        ("u2", 31, 1, 0, "not json"),
        ("u3", None, 1, 0, None),
        ("p1", 40, 0, 0, label_json(("volcano", 0.9))),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_categorize(assets):
    got = {r.asset_id: (r.kind, r.category) for r in cg.categorize(assets).collect()}
    assert got == {
        "f1": ("people", "people_single"), "f2": ("people", "people_group"),
        "f3": ("object", "Carton"), "f4": ("people", "people_single"), "h1": ("people", "people_single"),
        "o1": ("object", "Cat"), "o2": ("object", "Cat"), "o3": ("object", "Volcano"),
        "u1": (None, None), "u2": (None, None), "u3": (None, None),
    }


def test_limits_take_the_newest(assets):
    got = {r.asset_id: r.kind for r in cg.categorize(assets, people_limit=2, labeled_limit=4).collect()}
    # Newest two with faces: f5 (disqualified) and f4; newest four processed: h1, u2, u1, o3.
    assert got == {"f4": "people", "h1": "people", "u2": None, "u1": None, "o3": "object"}


def test_rollups(assets):
    done = cg.categorize(assets)
    rows = [tuple(r) for r in cg.category_rollup(done).collect()]
    assert rows == [
        ("object", "Cat", 2, "o2"), ("object", "Volcano", 1, "o3"), ("object", "Carton", 1, "f3"),
        ("people", "people_single", 3, "f4"), ("people", "people_group", 1, "f2"),
    ]
    assert [tuple(r) for r in cg.people_rollup(assets).collect()] == [
        ("people_single", 2, "f4"), ("people_group", 1, "f2")
    ]
    summary = cg.uncategorized_summary(assets, done).first()
    assert (summary.title, summary["count"], summary.cover_asset_id) == ("Uncategorized (+2 processing)", 5, "u2")
    last = cg.with_pending_bucket(cg.category_rollup(done), assets).collect()[-1]
    assert (last.id, last.title, last["count"]) == ("status_pending", "Processing (2)", 2)
    left = {r.asset_id for r in cg.anti_categorized(assets, done).collect()}
    assert left == {r.asset_id for r in cg.uncategorized(done).collect()} == {"u1", "u2", "u3"}


def test_translated_categories_merge(spark, assets):
    table = spark.createDataFrame([("cat", "X"), ("volcano", "X")], "label string, zh string")
    rows = cg.category_rollup(cg.categorize(assets, "zh", table)).collect()
    assert [(r.category, r["count"]) for r in rows if r.kind == "object"] == [("X", 3), ("Carton", 1)]


def test_large_tables_take_the_join_path(spark, monkeypatch):
    rng = random.Random(2)
    table = spark.createDataFrame([(f"w{i}", f"Z{i}") for i in range(30)], "label string, zh string")
    labels = spark.createDataFrame(
        [(i, rng.choice([f" W{i} ", f"q, w{i % 7}, w3", "none", "", None])) for i in range(60)],
        "i int, label string",
    )
    small = cg.translate(labels, "label", "title", "zh", table).collect()
    words = spark.createDataFrame([(i, f"w{i}") for i in range(10)], "idx int, label string")
    detected = spark.createDataFrame(
        [("a", [("x", 1, 0.5), ("", 3, 0.4)]), ("b", [("", 11, 0.1), (None, 0, 0.2), ("", -1, 0.3)]), ("c", None)],
        "asset_id string, labels array<struct<text:string,index:int,confidence:double>>",
    )
    texts = {r.asset_id: r.t for r in cg.index_labels(detected, words).selectExpr("asset_id", "labels.text t").collect()}
    assert texts == {"a": ["x", "w3"], "b": ["Unknown", "w0", "Unknown"], "c": None}
    monkeypatch.setattr(cg, "LITERAL_ROWS", 3)
    large = cg.translate(labels, "label", "title", "zh", table).collect()
    assert {r.i: r.title for r in large} == {r.i: r.title for r in small}
    joined = cg.index_labels(detected, words).selectExpr("asset_id", "labels.text t").collect()
    assert {r.asset_id: r.t for r in joined} == texts


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("background\ntench\n\ncrane\ncrane\n")
    vocab = vocabulary.load_label_vocab(spark, str(tmp_path / "labels.txt"))
    assert [(r.idx, r.label) for r in vocab.collect()] == [(0, "background"), (1, "tench"), (2, ""), (3, "crane"), (4, "crane")]
    assert [r.label for r in vocabulary.vocab_duplicates(vocab).collect()] == ["crane"]
    flags = vocabulary.dedupe_keep_first(vocab, ["label"], "idx").collect()
    assert [r.idx for r in flags if r.is_duplicate] == [4]
    (tmp_path / "names.ts").write_text('export const X = {\n  // c\n  "kit fox": "F",\n  \'tabby\': "old"\n};\n')
    names = {r.label: r.zh for r in vocabulary.load_translations(spark, str(tmp_path / "names.ts")).collect()}
    assert names["kit fox"] == "F" and names["tabby"] == "斑纹猫" and len(names) == 85


def test_faces(spark):
    seen = spark.createDataFrame(
        [("f1", "a", 3), ("f1", "b", 1), ("f2", "c", 2)], "face_id string, asset_id string, seen_at bigint"
    )
    rows = [tuple(r) for r in faces.face_group_counts(seen).collect()]
    assert rows == [("f1", "b", 2, 1), ("f2", "c", 1, 2)]
    groups = spark.createDataFrame(
        [("f1", 1), ("f2", None), ("f3", 1)], "face_id string, cluster_id int"
    )
    clusters = spark.createDataFrame([("f2", 5), ("f3", None)], "face_id string, cluster_id int")
    assigned = faces.face_cluster_assign(groups, clusters)
    assert {r.face_id: r.cluster_id for r in assigned.collect()} == {"f1": 1, "f2": 5, "f3": None}
    assert tuple(faces.face_statistics(groups).first()) == (2, 1)
