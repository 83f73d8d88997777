import random

import pytest

from photofold.operators import review
from photofold.streaming.review import as_events

EVENTS = "library_id string, seq bigint, asset_id string, media_type string, action string"


def random_log(seed, n=300, library="L"):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        media = rng.choice(["photo", "video"])
        if rng.random() < 0.06:
            acts = {
                "photo": ["confirm", "confirm_failed", "batch_reset", "load", "progress_reset"],
                "video": ["confirm", "confirm_failed", "progress_reset"],
            }[media]
            rows.append((library, seq, None, media, rng.choice(acts)))
            continue
        acts = {
            "photo": ["delete", "collect", "skip", "album", "undo"],
            "video": ["trash", "processed", "restore", "restore"],
        }[media]
        asset = "hot" if rng.random() < 0.3 else f"x{rng.randrange(8)}"
        rows.append((library, seq, asset, media, rng.choice(acts)))
    return rows


def replay(rows):
    """Run the actions one by one on plain sets."""
    done, delete, collect, seen, trash, watched = set(), set(), set(), set(), set(), set()
    for _, _, asset, media, action in sorted(rows, key=lambda r: r[1]):
        if asset is not None:
            seen.add((media, asset))
        if media == "photo":
            if action in ("delete", "collect", "skip", "album"):
                done.add(asset)
            if action == "delete":
                delete.add(asset)
            if action == "collect":
                collect.add(asset)
            if action == "undo":
                done.discard(asset), delete.discard(asset), collect.discard(asset)
            if action in ("confirm", "confirm_failed"):
                delete.clear()
            if action in ("batch_reset", "load"):
                delete.clear(), collect.clear()
            if action == "progress_reset":
                done.clear(), delete.clear(), collect.clear()
        else:
            if action in ("trash", "processed"):
                watched.add(asset)
            if action == "trash":
                trash.add(asset)
            if action == "restore" and asset in trash:
                trash.discard(asset), watched.discard(asset)
            if action == "confirm":
                trash.clear()
            if action == "progress_reset":
                trash.clear(), watched.clear()
    return {
        (m, a): (a in done, a in delete, a in collect, False) if m == "photo"
        else (a in watched, False, False, a in trash)
        for m, a in seen
    }


def flags(rows):
    return {
        (r.media_type, r.asset_id): (
            r.processed, r.in_delete_queue, r.in_collection_queue, r.in_trash
        )
        for r in rows
    }


@pytest.mark.parametrize("block_rows", [5, None])
def test_fold_equals_replay(spark, block_rows):
    logs = {f"L{i}": random_log(i, library=f"L{i}") for i in range(6)}
    df = spark.createDataFrame([r for log in logs.values() for r in log], EVENTS).repartition(5)
    got = review.review_fold(df, block_rows).collect()
    for name, log in logs.items():
        assert flags(r for r in got if r.library_id == name) == replay(log)


def test_state_stands_for_its_log(spark):
    log = random_log(77)
    early = spark.createDataFrame([r for r in log if r[1] < 150], EVENTS).drop("library_id")
    late = spark.createDataFrame([r for r in log if r[1] >= 150], EVENTS).drop("library_id")
    state = review.review_fold(early)
    assert flags(review.review_fold(late.unionByName(as_events(state))).collect()) == replay(log)


def test_failure_streak(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.choice([0, 0, 0, 1, 2])}", i, rng.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, failed boolean").repartition(4)
    got = {r.seq: r.disabled for r in review.failure_streak(df, block_rows=7).collect()}
    streak, tripped = {}, set()
    for session, seq, failed in rows:
        assert got[seq] == (session in tripped)
        streak[session] = streak.get(session, 0) + 1 if failed else 0
        if streak[session] == 4:
            tripped.add(session)
    assert len(got) == 300


LISTING = "asset_id string, media_type string, creation_time bigint"


def test_review_batch(spark):
    listing = spark.createDataFrame([(f"p{i:02d}", "photo", i) for i in range(30)], LISTING)
    bridge = spark.createDataFrame(
        [("A", f"p{i:02d}") for i in range(0, 30, 2)] + [("B", f"p{i:02d}") for i in range(0, 30, 3)],
        "album_id string, asset_id string",
    )
    seen = spark.createDataFrame([("p28",)], "asset_id string")

    def ids(**kw):
        return [r.asset_id for r in review.review_batch(listing, bridge, seen, **kw).collect()]

    assert ids(count=3, order="newest") == ["p29", "p27", "p26"]
    assert ids(count=3, order="oldest") == ["p00", "p01", "p02"]
    # The cap comes before the reviewed ones are taken out.
    assert ids(count=9, order="newest", source_cap=3) == ["p29", "p27"]
    assert ids(count=4, order="newest", album_ids=["B", "A"], source_cap=3) == ["p27", "p24", "p21", "p26"]
    shuffled = ids(count=50, seed=4, source_cap=10)
    assert shuffled == ids(count=50, seed=4, source_cap=10) != sorted(shuffled)
    assert sorted(shuffled) == [f"p{i}" for i in range(20, 30) if i != 28]
    assert len(ids(count=99, album_ids=["A", "B"])) == 25 - 1


def test_review_batch_goes_on_behind_what_was_reviewed(spark):
    listing = spark.createDataFrame([(f"p{i:04d}", "photo", i) for i in range(700)], LISTING)
    bridge = spark.createDataFrame([], "album_id string, asset_id string")
    seen = listing.filter("creation_time >= 100").select("asset_id")
    batch = review.review_batch(listing, bridge, seen, 20, order="newest").collect()
    assert [r.asset_id for r in batch] == [f"p{i:04d}" for i in range(99, 79, -1)]


def test_albums(spark):
    listing = spark.createDataFrame([("a", "photo", 1), ("b", "video", 2), ("c", "photo", 3)], LISTING)
    bridge = spark.createDataFrame([("A", "a"), ("A", "c"), ("B", "a")], "album_id string, asset_id string")
    assert [r.asset_id for r in review.scan_media(listing).collect()] == ["a", "c"]
    assert [r.asset_id for r in review.scan_media(listing, "photo", bridge, ["B"]).collect()] == ["a"]
    assert review.album_restrict(listing, bridge, ["A", "B"]).count() == 3
    assert review.album_restrict(listing, bridge).count() == 3
    assert review.union_albums(listing, bridge, ["A", "B"], distinct=True).count() == 2
    moves = spark.createDataFrame([("C", "a"), ("C", "a")], "album_id string, asset_id string")
    new_bridge, left, moved = review.album_move(bridge, listing, moves)
    assert (new_bridge.count(), left.count(), moved.count()) == (4, 2, 1)
