import base64
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from photofold.config import BlurConfig
from photofold.functions import images as img
from photofold.functions import labels as lab
from photofold.operators import groups, quality


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def features_by_hand(content):
    text = base64.b64encode(content or b"").decode()
    if not text:
        return 150.0, 128.0, "0" * 16
    sample = text[:1000]
    mean = sum(map(ord, sample)) / len(sample)
    luma = float(math.floor((mean - 43) / 79 * 255 + 0.5))
    step = len(text) // 65
    bits = sum(1 << i for i in range(64) if text[i * step] < text[(i + 1) * step])
    return max(0.0, min(500.0, (len(text) - 5000) / 45000 * 500)), luma, f"{bits:016x}"


def test_features_match_the_base64_formulas(spark):
    rng = random.Random(5)
    sizes = [0, 1, 2, 3, 46, 47, 48, 49, 50, 749, 750, 751, 3_700, 40_001, 60_000]
    contents = [bytes(rng.randrange(256) for _ in range(n)) for n in sizes]
    rows = [(str(i), bytearray(c)) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "asset_id string, content binary")
    got = {r.asset_id: r for r in quality.image_features(df).collect()}
    for i, content in enumerate(contents):
        blur, luma, phash = features_by_hand(content)
        row = got[str(i)]
        assert row.blur_score == pytest.approx(blur, abs=1e-9)
        assert row.mean_luma == luma, len(content)
        assert row.phash == phash, len(content)


def test_unreadable_image_is_an_error_row(spark):
    df = spark.createDataFrame([("a", None), ("b", bytearray(b"x"))], "asset_id string, content binary")
    got = {r.asset_id: r for r in quality.image_features(df).collect()}
    assert got["a"].error_message and got["a"].phash is None
    assert got["b"].error_message is None


def test_features_function_can_be_replaced(spark):
    df = spark.createDataFrame([("a", bytearray(b"xyz"))], "asset_id string, content binary")

    def constant(images):
        return images.withColumns(
            {"blur_score": F.lit(7.0), "mean_luma": F.lit(1.0), "phash": F.lit("ff")}
        )

    assert quality.image_features(df, constant).first()["blur_score"] == 7.0


def test_hamming(spark):
    rows = [
        ("0" * 16, "f" * 16, 64),
        ("8" + "0" * 15, "0" * 16, 1),
        ("00ff", "0f0f", 8),
        ("", "0f", None),
        (None, "0f", None),
        ("zz", "0f", None),
        ("0" * 16, "0000000000003fff", 14),
        ("0" * 16, "0000000000007fff", 15),
    ]
    got = values(
        spark, rows, "a string, b string, d int", "d", img.hamming64("a", "b"), img.are_similar("a", "b")
    )
    for want, distance, similar in got:
        assert distance == want
        assert similar == (None if want is None else want < 15)


@pytest.mark.parametrize(
    ("luma", "threshold"), [(39.0, 70.0), (40.0, 100.0), (220.0, 100.0), (221.0, 70.0), (None, 100.0)]
)
def test_blur_threshold(spark, luma, threshold):
    got = values(spark, [(luma,)], "luma double", img.blur_threshold("luma", BlurConfig()))
    assert got[0][0] == pytest.approx(threshold)


def test_blur_is_strict(spark):
    rows = [("a", 100.0, 128.0), ("b", 99.999, 128.0), ("c", 70.0, 10.0), ("d", None, 10.0)]
    df = spark.createDataFrame(rows, "asset_id string, blur_score double, mean_luma double")
    got = {r.asset_id: r.is_blurry for r in quality.detect_blur(df).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": None}


def test_score(spark):
    rows = [("a", 4000, 3000, 600.0, 140.0), ("b", None, 3000, None, None), ("c", 10, 10, 5.0, 255.0)]
    df = spark.createDataFrame(
        rows, "asset_id string, width int, height int, blur_score double, mean_luma double"
    )
    got = {r.asset_id: r for r in groups.score_assets(df).collect()}
    assert got["a"].resolution == pytest.approx(70.79, abs=0.01)
    assert (got["a"].sharpness, got["a"].lighting) == (100.0, 40.0)
    assert (got["b"].resolution, got["b"].sharpness, got["b"].lighting) == (0.0, 0.0, 28.0)
    assert got["c"].lighting == 0.0


@pytest.mark.parametrize(
    ("label", "group"),
    [
        ("tiger cat", "cat"), ("Siamese cat", "cat"), ("hotdog", None), ("prairie dog", None),
        ("Cardigan", "dog"), ("a cardigan", "people"), ("golden retriever", "dog"),
        ("bald eagle", "bird"), ("window screen", "screenshot"), ("fire screen, fireguard", "screenshot"),
        ("bow tie", "people"), ("suit", None), ("catamaran", None), ("shih-tzu", "dog"),
        ("bull mastiff", "dog"), ("cat and dog", "cat"), ("écat", "cat"), ("wild_cat", None), ("", None),
        (None, None),
    ],
)
def test_category_group(spark, label, group):
    assert values(spark, [(label,)], "x string", lab.category_group("x"))[0][0] == group


LABELS = "labels array<struct<text:string,confidence:double>>"


@pytest.mark.parametrize(
    ("labels", "want"),
    [
        ([("volcano", 0.9)], (None, "volcano")),
        ([("volcano", 0.4)], None),
        ([("volcano", 0.7), ("tabby", 0.5)], ("cat", "cat")),
        ([("volcano", 0.8), ("tabby", 0.5)], (None, "volcano")),
        ([("volcano", 0.8), ("groom", 0.5)], ("people", "people")),
        ([("volcano", 0.7), ("tabby", 0.5), ("groom", 0.6)], ("cat", "cat")),
        ([("volcano", 0.7), ("groom", 0.5), ("tabby", 0.6)], ("people", "people")),
        ([("bald eagle", 0.9)], ("bird", "bird")),
        ([("x", 0.5)] * 5 + [("tabby", 0.9)], (None, "x")),
        ([("", 0.9), ("tabby", 0.5)], None),
        ([], None),
        (None, None),
    ],
)
def test_pick_label(spark, labels, want):
    got = values(spark, [(labels,)], LABELS, lab.pick_label("labels"))[0][0]
    assert (got and tuple(got)) == want


def test_parse_labels(spark):
    rows = [
        ('[{"text":"a","confidence":0.5},{"label":"b","confidence":1}]',),
        ('[{"text":"","label":"c","confidence":0.1}]',),
        ("not json",),
        (None,),
    ]
    got = values(spark, rows, "j string", lab.parse_labels("j"))
    assert [(r.text, r.confidence) for r in got[0][0]] == [("a", 0.5), ("b", 1.0)]
    assert got[1][0][0].text == "c"
    assert not got[2][0] and got[3][0] is None


def test_top_labels_keep_list_order_on_ties(spark):
    rows = [([("a", 0.5), ("b", 0.9), ("c", 0.5), ("d", 0.39)],)]
    got = values(spark, rows, LABELS, lab.top_labels("labels", 2)["text"])
    assert got[0][0] == ["b", "a"]


def test_translate_label(spark):
    table = {"tabby": "斑纹猫", "seashore": "海岸", "none": ""}
    rows = [("Tabby",), (" tabby ",), ("rock, Seashore",), ("none",), ("eBook",), ("",), (None,)]
    got = values(
        spark, rows, "x string", lab.translate_label("x", "zh", table), lab.translate_label("x", "en")
    )
    assert [g[0] for g in got] == ["斑纹猫", "斑纹猫", "海岸", "None", "EBook", "", ""]
    assert [g[1] for g in got] == ["Tabby", " tabby ", "Rock, Seashore", "None", "EBook", "", ""]


def test_localize_replaces_only_the_first_mark(spark):
    rows = [("{n}/{n}", "x", "k"), (None, "en {n}", "k"), ("", None, "k")]
    got = values(
        spark, rows, "a string, b string, k string", lab.localize("a", "b", "k", {"n": F.lit(3)})
    )
    assert [g[0] for g in got] == ["3/{n}", "en 3", "k"]


def test_valid_face_count(spark):
    box = Row(x=0.0, y=0.0, width=101.0, height=1.0)
    small = Row(x=0.0, y=0.0, width=100.0, height=1.0)
    faces = [(box, 0.85), (small, 0.85), (None, 0.85)]
    rows = [
        (faces, [("tabby", 0.9)], 1000), (faces, [("tabby", 0.9)], 0), (faces, None, None),
        (faces, [("Monitor", 0.41)], 1000), (faces, [("monitor", 0.4)], 1000), (None, None, 10),
    ]
    schema = (
        "faces array<struct<bounding_box:struct<x:double,y:double,width:double,height:double>,"
        f"confidence:double>>, {LABELS}, w int"
    )
    got = values(spark, rows, schema, lab.valid_face_count("faces", "labels", "w"))
    assert [g[0] for g in got] == [1, 1, 1, 0, 1, 0]


def test_crop_date_and_ids(spark):
    x, y, size = img.center_crop("w", "h")
    got = values(
        spark, [(301, 200, 1_704_067_200_000)], "w int, h int, t bigint",
        x, y, size, lab.date_string("t"), lab.group_id(F.lit("lib"), F.lit("a1")),
    )
    assert got[0] == (50.5, 0.0, 200, "2024-01-01 00:00", "grp_lib_a1")
