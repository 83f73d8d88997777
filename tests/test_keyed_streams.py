import random
from collections import Counter

from photofold.operators import groups, similarity
from photofold.streaming import ingest
from photofold.streaming.keyed import Arrivals, KeyedGroups, KeyedReview, StatusCounters
from test_review import flags, random_log, replay
from test_similarity import SCHEMA, library


def arriving(spark, parts, schema, folder):
    """After each of these the stream of the folder has a part more; the stream is read anew each time."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).repartition(2).write.parquet(f"{folder}/part={k:03d}")
        yield ingest.read_new_files(spark, f"{folder}/*", schema)


def test_rows_come_out_as_on_time_repeated_or_late(spark, tmp_path):
    schema = "asset_id string, taken_at bigint, big bigint"
    big = (1 << 62) + 1
    parts = [
        [("a", 10_000, big), ("a", 10_000, None), ("b", 50_000, big), ("n", None, 1)],
        [("b", 50_000, 2), ("c", 39_999, 2), ("d", 40_000, 2), ("a", 60_000, big)],
        [("d", 45_000, 3), ("a", 69_999, 3), ("e", 90_000, 3)],
        [("b", 85_000, 4)],
    ]
    out = Arrivals(f"{tmp_path}/out", ["asset_id"], "taken_at", 10_000)
    for rows in arriving(spark, parts, schema, f"{tmp_path}/in"):
        ingest.run_available(out.start(rows))
    got = out.rows(spark).select("asset_id", "taken_at", "big", "arrival").collect()
    assert Counter((r.asset_id, r.taken_at, r.big) for r in got) == Counter(row for part in parts for row in part)
    kinds = {}
    for r in got:
        kinds.setdefault(r.arrival, []).append((r.asset_id, r.taken_at))
    assert sorted(kinds["late"]) == [("c", 39_999), ("d", 45_000)]
    assert kinds["undated"] == [("n", None)]
    # a is known until 20,000, and again until 70,000; the watermark was 40,000 and 50,000. b is known until 60,000, which is over at 80,000.
    assert sorted(kinds["on_time"]) == [("a", 10_000), ("a", 60_000), ("b", 50_000), ("b", 85_000), ("d", 40_000), ("e", 90_000)]
    assert sorted(kinds["repeat"]) == [("a", 10_000), ("a", 69_999), ("b", 50_000)]


def test_status_counters_after_every_batch(spark, tmp_path):
    r = random.Random(3)
    schema = "library_id string, asset_id string, status int, updated_at bigint"
    parts = [
        [(r.choice("LM"), f"a{r.randrange(30)}", r.randrange(3), r.choice([None, *range(k * 10, k * 10 + 15)])) for _ in range(40)] for k in range(4)
    ]
    counters, last = StatusCounters(f"{tmp_path}/out", libraries=True), {}
    order = lambda v: (v[1] is not None, v[1] or 0, v[0])
    for part, rows in zip(parts, arriving(spark, parts, schema, f"{tmp_path}/in")):
        counters.run(rows)
        for name, asset, status, at in part:
            key = (name, asset)
            if key not in last or order((status, at)) > order(last[key]):
                last[key] = (status, at)
        want = Counter((name, status) for (name, _), (status, _) in last.items())
        assert {(x.library_id, x.status): x["count"] for x in counters.counts(spark).collect()} == dict(want)


def test_review_state_by_key(spark, tmp_path):
    log = random_log(9, 400)
    schema = "library_id string, seq bigint, asset_id string, media_type string, action string"
    parts = [log[i : i + 70] for i in range(0, len(log), 70)]
    stream = KeyedReview(f"{tmp_path}/out", libraries=True, shards=3)
    seen = []
    for part, rows in zip(parts, arriving(spark, parts, schema, f"{tmp_path}/in")):
        ingest.run_available(stream.start(rows))
        seen += part
    assert flags(stream.state(spark).collect()) == replay(log)
    changed = spark.read.parquet(f"{tmp_path}/out/changes/*")
    ids = {(r.library_id, r.asset_id) for r in changed.collect()}
    assert ids == {(e[0], e[2]) for e in log if e[2] is not None}


def in_time(rows):
    return sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1]))


COLUMNS = SCHEMA + ", width int, height int, blur_score double, mean_luma double"


def with_quality(rows, seed):
    r = random.Random(seed)
    return [(*row, r.choice([None, 100, 4000]), 300, r.choice([None, 10.0, 400.0]), r.choice([None, 140.0])) for row in rows]


def test_groups_of_many_libraries_by_key(spark, tmp_path):
    rows = with_quality(in_time([x for k in range(4) for x in library(50 + k, 120, hot=k == 1, name=f"L{k}")]), 1)
    parts = [rows[i : i + 80] for i in range(0, len(rows), 80)]
    assert len(parts) >= 6 or len(rows) < 480
    stream = KeyedGroups(f"{tmp_path}/out")
    for part in arriving(spark, parts, COLUMNS, f"{tmp_path}/in"):
        ingest.run_available(stream.start(part))  # every start goes on from the checkpoint
    assets = spark.createDataFrame(rows, COLUMNS)
    whole = similarity.dup_groups(assets)
    columns = ["library_id", "group_id", "asset_id", "representative_asset_id", "distance_to_parent"]
    assert sorted(map(tuple, stream.members(spark).select(*columns).collect()), key=repr) == sorted(map(tuple, whole.select(*columns).collect()), key=repr)
    assert not stream.late(spark).count()
    best = groups.best_shot(whole, assets)
    columns = ["library_id", "group_id", "best_asset_id", "score"]
    assert sorted(map(tuple, stream.best(spark).select(*columns).collect())) == sorted(map(tuple, best.select(*columns).collect()))


def test_late_assets_of_a_library_come_out_as_such(spark, tmp_path):
    def row(name, asset, time):
        return (name, asset, time, "0" * 16, 1, 10, 10, 1.0, 1.0)

    parts = [[row("L", "b", 2000), row("L", "c", 3000)], [row("L", "a", 1000), row("L", "c", 3000), row("L", "d", 3000), row("M", "a", 1)], [row("L", "e", 900_000)]]
    stream = KeyedGroups(f"{tmp_path}/out")
    for part in arriving(spark, parts, COLUMNS, f"{tmp_path}/in"):
        ingest.run_available(stream.start(part))
    assert sorted((r.library_id, r.asset_id) for r in stream.late(spark).collect()) == [("L", "a"), ("L", "c")]
    assert {(r.library_id, r.asset_id): r.group_id[-1] for r in stream.members(spark).collect()} == {
        ("L", "b"): "b", ("L", "c"): "b", ("L", "d"): "b", ("L", "e"): "e", ("M", "a"): "a",
    }


def updated_rows(writer):
    """The most state rows that a batch has written."""
    stream = writer.trigger(availableNow=True).start()
    stream.awaitTermination()
    return max(o.numRowsUpdated for p in stream.recentProgress for o in p.stateOperators)


def test_arrivals_write_state_by_shard(spark, tmp_path):
    schema = "asset_id string, tags array<int>, x double, taken_at bigint"
    part = [(f"a{k}", [k, 1], float("nan"), 1000) for k in range(900)] + [(None, None, None, 1000)]
    out = Arrivals(f"{tmp_path}/out", ["asset_id", "tags", "x"], "taken_at", 10_000, shards=8)
    for rows in arriving(spark, [part, part], schema, f"{tmp_path}/in"):
        assert updated_rows(out.start(rows)) <= 2 * 8  # a value and a timer
    assert Counter(r.arrival for r in out.rows(spark).collect()) == {"on_time": 901, "repeat": 901}


def test_status_counters_write_state_by_shard(spark, tmp_path):
    schema = "asset_id string, status int, updated_at bigint"
    late = (1 << 62) + 1
    parts = [[(f"a{k}", k % 3, late) for k in range(900)] + [(None, None, None)], [(f"a{k}", 2, late + k % 2) for k in range(900)] + [(None, 1, None)]]
    counters = StatusCounters(f"{tmp_path}/out", shards=8)
    for rows in arriving(spark, parts, schema, f"{tmp_path}/in"):
        assert updated_rows(counters.steps(rows)) <= 8
    ingest.run_available(counters.totals(spark))
    assert {x.status: x["count"] for x in counters.counts(spark).collect()} == {2: 900, 1: 1}
