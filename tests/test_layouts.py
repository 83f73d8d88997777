"""Layouts, filters and sources that spare reading or moving what isn't wanted."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photofold.operators import catalog as cat
from photofold.operators import faces, quality, scan
from photofold.plans import bloom
from photofold.schemas import ASSETS, MEDIA_LISTING
from photofold.sources import clustered, pages
from photofold.streaming import ingest
from photofold.streaming.catalog import BucketedCatalog, CompactedCatalog


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("libraries", [False, True])
def test_bloom_filter_keeps_all_keys_and_few_others(spark, libraries):
    keys = ["library_id"] * libraries + ["asset_id"]
    rows = spark.range(20_000).select(*[F.lit("L").alias(k) for k in keys[:-1]], F.concat(F.lit("a"), "id").alias("asset_id"), F.lit(1).alias("content"))
    ids = rows.filter(F.substring("asset_id", 2, 9).cast("int") % 10 == 0).select(*keys)
    kept = bloom.might_be_among(rows, ids, keys)
    assert kept.columns == rows.columns
    assert ids.join(kept, keys, "left_anti").count() == 0
    assert kept.count() < 2000 + 0.02 * 18_000
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_bloom_filter_has_a_bound_and_takes_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 4)
    rows = spark.createDataFrame([(f"a{k}",) for k in range(5000)] + [(None,)], "asset_id string")
    ids = rows.filter("asset_id LIKE 'a1%' OR asset_id IS NULL")
    table, blocks = bloom.bloom_blocks(ids, ["asset_id"], ids.count())
    assert blocks == 4 and table.count() <= 4
    assert ids.join(bloom.might_be_among(rows, ids, ["asset_id"]), "asset_id", "left_anti").filter("asset_id IS NOT NULL").count() == 0
    assert bloom.might_be_among(rows, ids.limit(0), ["asset_id"]).count() == 0


def test_models_see_pending_images_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def features(images):
        @F.udf("double")
        def counted(content):
            seen.add(1)
            return float(len(content))

        return images.withColumns({"blur_score": counted("content"), "mean_luma": F.lit(9.0), "phash": F.lit("00")})

    images = spark.range(30_000).select(F.format_string("a%05d", "id").alias("asset_id"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    todo = images.filter("asset_id < 'a02000'").select("asset_id")
    found = quality.features_of(todo, images, features, few=1000)
    assert found.filter("blur_score IS NOT NULL").count() == 2000
    assert 2000 <= seen.value < 2000 + 0.02 * 28_000


def test_scan_of_many_pending_assets(spark, monkeypatch):
    monkeypatch.setattr(quality.wanted_images, "__defaults__", (2,))
    monkeypatch.setattr(quality.features_of, "__defaults__", (None, 2))
    rows = [(f"a{k}", 1, 64, 64, "s", 1, None, None, None, None, k % 2, None, 1, None) for k in range(40)]
    catalog = spark.createDataFrame(rows, ASSETS)
    images = spark.createDataFrame([(f"a{k}", bytearray(b"x" * 200)) for k in range(0, 40, 4)], "asset_id string, content binary")
    done = {r.asset_id: r.status for r in scan.scan_pending(catalog, images, 2, F.lit(5).cast("bigint")).collect()}
    assert done == {f"a{k}": 1 if k % 2 or k % 4 == 0 else 2 for k in range(40)}


def test_sketches_of_days_are_merged(spark):
    day = 86_400_000
    rows = [(k % 2, f"f{k}", k % 700 if k % 5 else None, day * (k % 3)) for k in range(30_000)] + [(1, "f1", 1, day * 2)]
    schema = "library_id string, face_id string, cluster_id int, created_at bigint"
    groups = spark.createDataFrame([(f"L{a}", b, c, d) for a, b, c, d in rows], schema)
    sketches = faces.face_sketches(groups)
    assert sketches.select("day").distinct().count() == 3
    exact = {r.library_id: r for r in faces.face_statistics(groups).collect()}
    for r in faces.estimated_statistics(sketches).collect():
        assert r.total_faces == pytest.approx(exact[r.library_id].total_faces, rel=0.02)
        assert r.total_clusters == pytest.approx(exact[r.library_id].total_clusters, rel=0.02)
    assert sorted(r.day for r in sketches.select("day").distinct().collect())[0] == datetime.date(1970, 1, 1)


def test_compaction_writes_the_buckets_of_the_log(spark, tmp_path):
    schema = StructType.fromDDL("asset_id string, width int, status int")
    base = spark.createDataFrame([(f"a{k}", k, 1) for k in range(300)], schema)
    table, whole = BucketedCatalog(str(tmp_path / "b"), schema, buckets=16), CompactedCatalog(str(tmp_path / "c"))
    table.start(base)
    whole.start(base)
    r, log, empty = random.Random(2), [], "asset_id string, seq bigint, width int, status int"
    sizes = []
    for step in range(3):
        log += [(f"a{r.randrange(320)}", step * 10 + k, r.choice([None, k]), r.choice([None, 2])) for k in range(3)]
        rows = spark.createDataFrame(log, empty)
        touched = table.compact(spark, rows)
        whole.compact(spark, rows)
        assert 1 <= len(touched) <= 3
        written = [p.name for p in (tmp_path / "b/base/data" / f"{step + 1:012d}").iterdir() if p.is_dir()]
        assert sorted(int(n.split("=")[1]) for n in written) == touched
        sizes.append(sum(f.stat().st_size for f in (tmp_path / "b/base/data" / f"{step + 1:012d}").rglob("*.parquet")))
        assert tuples(table.current(spark, rows)) == tuples(whole.current(spark, rows))
    first = sum(f.stat().st_size for f in (tmp_path / "b/base/data" / f"{0:012d}").rglob("*.parquet"))
    assert max(sizes) < first / 3
    assert table.compact(spark, rows) == []
    later = spark.createDataFrame([*log, ("a1", 100, 77, None)], empty)
    assert {x.asset_id: x.width for x in table.current(spark, later).collect()}["a1"] == 77
    table.table.vacuum(spark)
    assert tuples(table.current(spark, later)) == tuples(whole.current(spark, later))


def test_clustered_catalog_opens_the_months_it_needs(spark, tmp_path):
    r = random.Random(8)
    start = 1_577_836_800_000  # 2020-01-01
    rows = [(r.choice("LM"), f"a{k:04d}", None if k % 50 == 0 else start + r.randrange(400) * 86_400_000, 0) for k in range(2000)]
    catalog = spark.createDataFrame(rows, "library_id string, asset_id string, taken_at bigint, status int")
    clustered.write_clustered(catalog, str(tmp_path))
    assert tuples(clustered.read_clustered(spark, str(tmp_path)).select(*catalog.columns)) == tuples(catalog)
    cursor = start + 300 * 86_400_000
    some = clustered.read_clustered(spark, str(tmp_path), since=cursor)
    paged = cat.keyset_page(some, cursor, "a0500", 5)
    assert [tuple(x) for x in paged.collect()] == [tuple(x) for x in cat.keyset_page(catalog, cursor, "a0500", 5).collect()]
    plan = paged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(taken_month" in plan and "GreaterThanOrEqual(taken_at" in plan
    scan_node = some._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    files = scan_node.selectedPartitions().totalNumberOfFiles() if hasattr(scan_node.selectedPartitions(), "totalNumberOfFiles") else None
    every = len(list(tmp_path.rglob("*.parquet")))
    assert files is None or files < every / 2
    one = clustered.read_clustered(spark, str(tmp_path), since=cursor, until=cursor + 86_400_000, library="L")
    assert tuples(one.select(*catalog.columns)) == tuples(catalog.filter(f"library_id = 'L' AND taken_at BETWEEN {cursor} AND {cursor + 86_400_000}"))


def listing(some):
    return [(f"a{k:04d}", "photo" if k % 3 else "video", None if k % 97 == 5 else 1000 + k // 4, 1, 2, "u", "l", 1, 2) for k in some]


def test_a_listing_is_read_page_by_page(spark, tmp_path):
    client = pages.FolderListing(f"file://{tmp_path}")
    rows = spark.createDataFrame(listing(range(1000)), MEDIA_LISTING)
    rows.repartitionByRange(3, "creation_time").write.mode("append").parquet(str(tmp_path))
    cursor, seen, calls = None, [], 0
    hints = client.ranges(None, client.newest())
    for after, until, hint in hints:
        cursor, more = after, True
        while more:
            page = client.page(cursor, until, hint, 100)
            seen += page.entries["asset_id"].to_pylist()
            assert len(page.entries) == 100 or not page.has_next_page
            cursor, more, calls = page.end_cursor, page.has_next_page, calls + 1
    assert sorted(seen) == [f"a{k:04d}" for k in range(1000)] and calls >= 10 and len(hints) > 1
    pages.register_listing(spark, "test_pages", client)
    read = spark.read.format("test_pages").load()
    assert tuples(read) == tuples(rows) and read.rdd.getNumPartitions() == len(hints)


def test_a_stream_of_pages_goes_on_after_a_stop(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [listing(range(1, 300)), listing(range(300, 500)), [("late", "photo", 1, 1, 2, "u", "l", 1, 2)], listing(range(500, 505))]
    pages.register_listing(spark, "test_page_stream", pages.FolderListing(folder), page_rows=50)
    seen = 0
    for k, part in enumerate(parts):
        spark.createDataFrame(part, MEDIA_LISTING).repartition(2).write.mode("append").parquet(folder)
        rows = spark.readStream.format("test_page_stream").load()
        ingest.run_available(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp"))
        seen += 0 if k == 2 else sum(r[2] is not None or k == 0 for r in part)  # entries behind the cursor are left to a batch read
        assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == seen


@pytest.mark.parametrize("statistics", [True, False])
def test_a_listing_is_paged_from_footers_and_by_halving(tmp_path, monkeypatch, statistics):
    names = [f.split()[0] for f in MEDIA_LISTING.split(", ")]
    files = [listing(range(5000, 30_000)), listing(range(5000)), [], [("n", "photo", None, 1, 2, "u", "l", 1, 2)]]
    for k, part in enumerate(files):
        random.Random(k).shuffle(part)
        columns = {n: pa.array([r[i] for r in part], pa.string() if i in (0, 1, 5, 6) else pa.int64()) for i, n in enumerate(names)}
        pq.write_table(pa.table(columns), tmp_path / f"{k}.parquet", row_group_size=1000, write_statistics=statistics)
    client, read = pages.FolderListing(str(tmp_path)), pq.read_table
    monkeypatch.setattr(pq, "read_table", None)  # what the files cover is asked of their footers
    order = sorted(((pages.NO_TIME if r[2] is None else r[2], r[0]) for part in files for r in part))
    newest = client.newest()
    assert newest == order[-1] == (1000 + 29_999 // 4, "a29999")
    assert len(client.ranges(None, newest)) == 3
    monkeypatch.setattr(pq, "read_table", read)
    for after, until in ((None, newest), (order[7000], order[21_000]), (order[3], order[4]), (newest, newest)):
        batches = [list(pages._entries(client, pages._Range(*r), 100, names)) for r in client.ranges(after, until)]
        got = sorted((pages.NO_TIME if t is None else t, a) for part in batches for b in part for t, a in zip(b["creation_time"].to_pylist(), b["asset_id"].to_pylist()))
        assert got == [c for c in order if (after is None or c > after) and c <= until]
        assert max(map(len, batches)) <= 4  # thousands of entries at once, not a page
