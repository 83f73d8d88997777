import random

import pytest

from photofold.config import SimilarityConfig
from photofold.operators import groups, similarity

SCHEMA = "library_id string, asset_id string, taken_at bigint, phash string, status int"


def library(seed, n=120, hot=False, name="L"):
    """Bursts, equal times, missing hashes and times, unscanned assets."""
    rng = random.Random(seed)
    rows, time, base = [], 1_000_000, rng.getrandbits(64)
    for i in range(n):
        if rng.random() < 0.2:
            base = rng.getrandbits(64)
        noise = 0
        for _ in range(rng.randrange(12)):
            noise |= 1 << rng.randrange(64)
        if not (hot and i % 3):
            time += rng.choice([0, 0, 1, 30_000, 119_999, 120_000, 120_001, 400_000])
        phash = None if rng.random() < 0.05 else f"{base ^ noise:016x}"
        if rng.random() < 0.03:
            phash = ""
        taken = rng.choice([None, 0]) if rng.random() < 0.04 else time
        status = rng.choice([0, 2]) if rng.random() < 0.1 else 1
        rows.append((name, f"a{rng.randrange(10**6):06d}{i}", taken, phash, status))
    rng.shuffle(rows)
    return rows


def distance(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def scan_one_by_one(rows, config):
    """Group assets the way a scan meets them: search, then join or found a group."""
    done, group_of = [], {}
    order = sorted((r for r in rows if r[4] == 1 and r[2]), key=lambda r: (r[2], r[1]))
    for asset in order:
        done.append(asset)
        newest = sorted(
            (d for d in done if abs(d[2] - asset[2]) <= config.window_ms),
            key=lambda d: (d[2], d[1]), reverse=True,
        )[: config.max_compare_count]
        if not asset[3]:
            continue
        matches = [(distance(asset[3], d[3]), i, d[1]) for i, d in enumerate(newest) if d[3]]
        matches = sorted(m for m in matches if m[0] < config.similar_threshold)
        found = next((group_of[m[2]] for m in matches if m[2] in group_of), None)
        group_of[asset[1]] = found or asset[1]
    return group_of


@pytest.mark.parametrize("block_rows", [9, 32, 4000])
@pytest.mark.parametrize("hot", [False, True])
def test_groups_equal_a_scan(spark, block_rows, hot):
    config = SimilarityConfig()
    rows = [r for i in range(4) for r in library(i, hot=hot, name=f"L{i}")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = similarity.dup_groups(df, config, block_rows).collect()
    for name in {r[0] for r in rows}:
        want = scan_one_by_one([r for r in rows if r[0] == name], config)
        mine = {r.asset_id: r.representative_asset_id for r in got if r.library_id == name}
        assert mine == want


def test_one_long_chain_across_many_blocks(spark):
    rows = [("L", f"a{i:05d}", 1000 + i, "0" * 16, 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).drop("library_id")
    got = similarity.dup_groups(df, block_rows=10).collect()
    assert len(got) == 400 and {r.group_id for r in got} == {"grp_a00000"}


def test_small_candidate_counts(spark):
    rows = library(9, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    for count in (1, 2, 3):
        config = SimilarityConfig(max_compare_count=count)
        got = similarity.dup_groups(df, config, 16).collect()
        assert {r.asset_id: r.representative_asset_id for r in got} == scan_one_by_one(rows, config)


def test_edge_bounds(spark):
    zero, at14, at15 = "0" * 16, "0000000000003fff", "0000000000007fff"
    rows = [
        ("L", "a", 1_000, zero, 1), ("L", "b", 121_000, at14, 1), ("L", "c", 241_001, at14, 1),
        ("M", "a", 1_000, zero, 1), ("M", "b", 1_000, at15, 1),
    ]
    got = similarity.dup_edges(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.library_id, r.asset_id, r.parent_id, r.distance) for r in got] == [("L", "b", "a", 14)]


@pytest.mark.parametrize("hot", [False, True])
def test_find_similar_equals_brute_force(spark, hot):
    config = SimilarityConfig()
    rows = [r for i in range(3) for r in library(20 + i, hot=hot, name=f"L{i}")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {
        (r.library_id, r.target_id, r.asset_id, r.distance, r.recency)
        for r in similarity.find_similar(df, df, config).collect()
    }
    want = set()
    for target in rows:
        if target[2] is None or not target[3]:
            continue
        newest = sorted(
            (r for r in rows if r[0] == target[0] and r[4] == 1 and r[2] is not None
             and abs(r[2] - target[2]) <= config.window_ms),
            key=lambda r: (r[2], r[1]), reverse=True,
        )[: config.max_compare_count]
        for i, other in enumerate(newest):
            if other[3] and distance(target[3], other[3]) < config.similar_threshold:
                want.add((target[0], target[1], other[1], distance(target[3], other[3]), i + 1))
    assert got == want
    without = similarity.find_similar(df, df, config, exclude_self=True)
    assert without.filter("target_id = asset_id").count() == 0


def test_best_shot_and_upkeep(spark):
    assets = spark.createDataFrame(
        [("a", 10, 10, 5.0, 140.0), ("b", 10, 10, 5.0, 140.0), ("c", 99, 99, 5.0, 140.0)],
        "asset_id string, width int, height int, blur_score double, mean_luma double",
    )
    members = spark.createDataFrame(
        [("g1", "b", 0), ("g1", "a", 3), ("g2", "c", 0), ("g2", "a", 1), ("g3", "gone", 0)],
        "group_id string, asset_id string, distance int",
    )
    all_groups = spark.createDataFrame(
        [("g1", None, "a", 1), ("g2", "c", "a", 2), ("g3", "gone", None, 3)],
        "group_id string, representative_asset_id string, best_asset_id string, created_at bigint",
    )
    best = {r.group_id: r.best_asset_id for r in groups.best_shot(members, assets).collect()}
    assert best == {"g1": "a", "g2": "c"}
    assert groups.count_best_shot_changes(all_groups, members, assets).first()[0] == 1
    mapping = spark.createDataFrame([("g1", "g2")], "source_id string, target_id string")
    left, merged = groups.merge_groups(all_groups, members, mapping)
    assert {r.group_id for r in left.collect()} == {"g2", "g3"}
    assert {(r.group_id, r.asset_id, r.distance) for r in merged.collect()} == {
        ("g2", "a", 1), ("g2", "b", 0), ("g2", "c", 0), ("g3", "gone", 0)
    }
    left, kept = groups.delete_groups(all_groups, members, left.filter("group_id = 'g2'"))
    assert left.count() == 2 and kept.filter("group_id = 'g2'").count() == 0
    deleted = spark.createDataFrame([("a",)], "asset_id string")
    remaining = {r.group_id: (r.remaining, r.processed) for r in
                 groups.remaining_after_delete(members, deleted).collect()}
    assert remaining == {"g1": (1, True), "g2": (1, True), "g3": (1, True)}
    order = [r.group_id for r in groups.processed_last(all_groups, mapping.selectExpr("'g3' AS group_id")).collect()]
    assert order == ["g2", "g1", "g3"]
