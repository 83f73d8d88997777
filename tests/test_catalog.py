import pytest
from pyspark.sql import functions as F

from photofold.operators import catalog
from photofold.schemas import ASSETS, META

NOW = 99


def now():
    return F.lit(NOW).cast("bigint")


def asset(asset_id, **kw):
    base = {
        "asset_id": asset_id, "taken_at": 1, "width": 2, "height": 3, "file_signature": "s",
        "algo_version": 1, "blur_score": 1.0, "mean_luma": 2.0, "phash": "ff", "labels_json": None,
        "status": 1, "error_message": None, "updated_at": 5, "face_count": 0,
    }
    return tuple({**base, **kw}.values())


def by_id(df):
    return {r.asset_id: r for r in df.collect()}


def test_sync(spark):
    known = spark.createDataFrame(
        [asset("same"), asset("changed", status=2), asset("gone"), asset("null", file_signature=None)],
        ASSETS,
    )
    listing = spark.createDataFrame(
        [("same", 7, 8, 9, "s"), ("changed", 7, 8, 9, "t"), ("new", 7, 8, 9, "u"), ("null", 7, 8, 9, "")],
        "asset_id string, creation_time bigint, width int, height int, file_signature string",
    )
    got = by_id(catalog.sync_catalog(known, listing, now()))
    assert {k: r.action for k, r in got.items()} == {
        "same": "keep", "changed": "reset", "gone": "keep", "new": "insert", "null": "reset"
    }
    assert (got["changed"].status, got["changed"].file_signature, got["changed"].taken_at) == (0, "t", 1)
    assert (got["new"].status, got["new"].taken_at, got["new"].width, got["new"].updated_at) == (0, 7, 8, NOW)
    assert (got["same"].status, got["same"].updated_at) == (1, 5)


def test_upsert_folds_a_log_of_partial_updates(spark):
    base = spark.createDataFrame([asset("a"), asset("b")], ASSETS)
    updates = spark.createDataFrame(
        [("a", 1, 10, None, 2), ("a", 2, None, 7.0, None), ("c", 3, None, None, None), ("c", 4, 5, None, 1)],
        "asset_id string, seq bigint, width int, blur_score double, status int",
    )
    got = by_id(catalog.upsert_coalesce(base, updates, "seq", now()))
    assert (got["a"].width, got["a"].blur_score, got["a"].status, got["a"].phash) == (10, 7.0, 0, "ff")
    assert (got["c"].width, got["c"].status, got["c"].phash) == (5, 1, None)
    assert (got["b"].updated_at, got["a"].updated_at) == (5, NOW)


def test_insert_or_replace(spark):
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], META)
    new = spark.createDataFrame([("a", "3", 1), ("a", "4", 2), ("c", None, 1)], META + ", seq bigint")
    got = {r.key: r.value for r in catalog.insert_or_replace(meta, new, ["key"], "seq").collect()}
    assert got == {"a": "4", "b": "2", "c": None}


def test_mark_results(spark):
    base = spark.createDataFrame([asset("a", status=0), asset("b", status=0), asset("c", status=0)], ASSETS)
    results = spark.createDataFrame(
        [("a", 8.0, 9.0, "00", None), ("b", None, None, None, "broken")],
        "asset_id string, blur_score double, mean_luma double, phash string, error_message string",
    )
    got = by_id(catalog.mark_results(base, results, 4, now()))
    assert (got["a"].status, got["a"].phash, got["a"].algo_version) == (1, "00", 4)
    assert (got["b"].status, got["b"].phash, got["b"].error_message, got["b"].algo_version) == (2, "ff", "broken", 1)
    assert (got["c"].status, got["c"].updated_at) == (0, 5)


def test_resets(spark):
    df = spark.createDataFrame(
        [asset("new", algo_version=3), asset("old", algo_version=2), asset("none", algo_version=None),
         asset("err", status=2, algo_version=1)], ASSETS,
    )
    got = by_id(catalog.reset_outdated(df, 3, now()))
    assert {k: r.status for k, r in got.items()} == {"new": 1, "old": 0, "none": 0, "err": 2}
    assert catalog.count_outdated(df, 3).first()[0] == 2
    got = by_id(catalog.reset_all(df, now()))
    assert all(r.status == 0 and r.face_count is None and r.phash == "ff" for r in got.values())
    assert by_id(catalog.retry_errors(df, now()))["err"].status == 0


@pytest.fixture(scope="module")
def waiting(spark):
    rows = [asset("n", taken_at=None, status=0)]
    rows += [asset(f"w{i:03d}", taken_at=1000 + i // 2, status=0) for i in range(50)]
    return spark.createDataFrame(rows + [asset("done")], ASSETS).repartition(4)


def test_paging_reaches_every_timed_asset_once(waiting):
    seen, page = [], catalog.keyset_page(waiting, limit=7).collect()
    assert page[0].asset_id == "n"
    while page:
        seen += [r.asset_id for r in page]
        page = catalog.keyset_page(waiting, page[-1].taken_at, page[-1].asset_id, 7).collect()
    assert seen == ["n", *[f"w{i:03d}" for i in range(50)]]


def test_batches_and_late(waiting):
    got = {r.asset_id: r.batch for r in catalog.scan_batches(waiting, 20).collect()}
    assert got["n"] == 0 and got["w018"] == 0 and got["w019"] == 1 and got["w049"] == 2
    late = {r.asset_id for r in catalog.late_assets(waiting, 1001, "w002").collect()}
    assert late == {"n", "w000", "w001", "w002"}


def test_counts_and_lookups(spark, waiting):
    row = catalog.status_counts(waiting).first()
    assert (row.pending, row.done, row.error) == (51, 1, 0)
    assert tuple(catalog.status_counts(waiting.limit(0)).first()) == (None, None, None)
    assert catalog.lookup(waiting, "asset_id", ["done", "n"]).count() == 2
    ids = spark.createDataFrame([("done",)], "asset_id string")
    assert catalog.lookup(waiting, "asset_id", ids).count() == 1
