import random

import pytest
from pyspark.sql import functions as F

from photofold.plans import hot_keys, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; the rest is spread."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(50)) for i in range(900)]
    return spark.createDataFrame(rows, "id int, k string, v int").repartition(7)


def test_position_is_the_global_rank(skewed):
    got = ordering.with_position(skewed, ["v", "id"]).collect()
    want = {r.id: i for i, r in enumerate(sorted(got, key=lambda r: (r.v, r.id)))}
    assert {r.id: r[ordering.POSITION] for r in got} == want


def test_running_total(skewed):
    got = ordering.with_running_total(skewed, ["v", "id"], "total", F.col("v")).collect()
    total = 0
    for row in sorted(got, key=lambda r: (r.v, r.id)):
        total += row.v
        assert row.total == total


@pytest.mark.parametrize("block_rows", [3, 10, 5000])
def test_blocks_see_the_rows_before(skewed, block_rows):
    blocks = ordering.in_blocks(ordering.with_position(skewed, ["v", "id"]), 3, block_rows)
    back = F.lag("id", 3).over(ordering.block_window())
    got = blocks.withColumn("back", back).filter(ordering.HOME).collect()
    by_position = {r[ordering.POSITION]: r for r in got}
    assert len(got) == len(by_position) == 900
    for position, row in by_position.items():
        assert row.back == (by_position[position - 3].id if position >= 3 else None)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, skewed, how):
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k1", 3), ("k5", 4), ("none", 5)], "k string, r int"
    )
    left = skewed.withColumn("k", F.when(F.col("id") % 11 > 0, F.col("k")))
    plain = left.join(right, ["k"], how).select("id", "k", "r").collect()
    salted = hot_keys.salted_join(left, right, ["k"], how, hot_rows=20).select("id", "k", "r").collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, salted))


def test_top_n_per_key(skewed):
    got = hot_keys.top_n_per_key(skewed, ["k"], [F.desc("v"), F.asc("id")], 4, salts=5).collect()
    want = {}
    for r in sorted(skewed.collect(), key=lambda r: (-r.v, r.id)):
        want.setdefault(r.k, []).append(r.id)
    assert {(r.k, r["_rank"], r.id) for r in got} == {
        (k, i + 1, x) for k, ids in want.items() for i, x in enumerate(ids[:4])
    }


def test_rank_in_key(skewed):
    got = hot_keys.rank_in_key(skewed, ["k"], [F.desc("v"), F.asc("id")], "rank").collect()
    seen = {}
    for r in sorted(got, key=lambda r: (-r.v, r.id)):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r["rank"] == seen[r.k]
    assert len(got) == 900


def test_fits_reads_no_more_than_the_limit(spark):
    assert hot_keys.fits(spark.range(5), 5)
    assert not hot_keys.fits(spark.range(6), 5)


def test_scan_does_not_shuffle_content(spark):
    from pyspark.sql import functions as F

    from photofold.operators import scan
    from photofold.schemas import ASSETS

    catalog = spark.createDataFrame([("a", 1, 64, 64, "s", 1, None, None, None, None, 0, None, 1, None)], ASSETS)
    images = spark.createDataFrame([("a", bytearray(b"x" * 99)), ("b", bytearray(b"y"))], "asset_id string, content binary")
    done = scan.scan_pending(catalog, images, 2, F.lit(5).cast("bigint"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert done.first()["status"] == 1
    # Above the projection that makes the features no column is called content.
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins
    executed = done._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in executed.split("\n") if "Exchange" in line and "content" in line]


def test_pluggable_features_and_labels(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from photofold.operators import scan
    from photofold.schemas import ASSETS

    @F.pandas_udf("double")
    def size(content: pd.Series) -> pd.Series:
        return content.map(len).astype(float)

    @F.pandas_udf("string")
    def first_byte(content: pd.Series) -> pd.Series:
        return content.map(lambda b: chr(b[0]))

    def features(images):
        return images.withColumns({"blur_score": size("content"), "mean_luma": F.lit(9.0), "phash": F.lit("00")})

    def labels(images):
        label = F.struct(first_byte("content").alias("text"), F.lit(0.9).cast("double").alias("confidence"))
        box = "array<struct<bounding_box:struct<x:double,y:double,width:double,height:double>,confidence:double>>"
        return images.select("asset_id", F.array(label).alias("labels"), F.lit(None).cast(box).alias("faces"))

    catalog = spark.createDataFrame([("a", 1, 64, 64, "s", 1, None, None, None, None, 0, None, 1, None)], ASSETS)
    images = spark.createDataFrame([("a", bytearray(b"xyz"))], "asset_id string, content binary")
    row = scan.scan_pending(catalog, images, 2, F.lit(5).cast("bigint"), features_fn=features, labels_fn=labels).first()
    assert (row.blur_score, row.mean_luma, row.status) == (3.0, 9.0, 1) and '"x"' in row.labels_json
