import pytest
from pyspark.sql import functions as F

from photofold.fixtures import registry
from photofold.operators import review, similarity
from photofold.sources import media
from photofold.streaming import catalog as stream_catalog
from photofold.streaming import ingest
from photofold.streaming.groups import GroupStream
from photofold.streaming.review import ReviewStream
from test_review import flags, random_log, replay
from test_similarity import SCHEMA, library

ASSET = SCHEMA + ", order_key bigint"


def write_parts(spark, rows, schema, folder, size):
    """One file per slice, written in order so that the stream reads them in order."""
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i : i + size], schema).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/part={i:05d}")


@pytest.mark.parametrize("libraries", [False, True])
def test_groups_batch_by_batch(spark, tmp_path, libraries):
    rows = library(31, 150) + (library(32, 150, name="M") if libraries else [])
    rows = sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1]))
    schema, rows = (SCHEMA, rows) if libraries else (SCHEMA.split(", ", 1)[1], [r[1:] for r in rows])
    write_parts(spark, rows, schema, f"{tmp_path}/in", 40)
    files = ingest.read_new_files(spark, f"{tmp_path}/in/*", schema, files_per_trigger=1)
    stream = GroupStream(f"{tmp_path}/out", block_rows=16)
    ingest.run_available(stream.start(files))
    got = {(r.asset_id, r.group_id) for r in stream.members(spark).collect()}
    whole = similarity.dup_groups(spark.createDataFrame(rows, schema)).collect()
    assert got == {(r.asset_id, r.group_id) for r in whole}
    assert stream.late(spark).count() == 0


def test_late_assets_are_set_aside(spark, tmp_path):
    schema = SCHEMA.split(", ", 1)[1]
    first = [("b", 2000, "0" * 16, 1), ("c", 3000, "0" * 16, 1)]
    stream = GroupStream(str(tmp_path))
    stream.process(spark.createDataFrame(first, schema), 0)
    second = [("a", 1000, "0" * 16, 1), ("c", 3000, "0" * 16, 1), ("d", 3000, "0" * 16, 1)]
    for _ in range(2):  # a repeated batch replaces its output
        stream.process(spark.createDataFrame(second, schema), 1)
    assert {r.asset_id: r.group_id for r in stream.members(spark).collect()} == {
        "b": "grp_b", "c": "grp_b", "d": "grp_b"
    }
    assert sorted(r.asset_id for r in stream.late(spark).collect()) == ["a", "c"]


def test_libraries_come_and_go(spark, tmp_path):
    rows = sorted((r for r in library(41, 120) + library(42, 120, name="M") if r[2]), key=lambda r: (r[2], r[1]))
    parts = [[r for r in rows if r[0] != "M"][:50], [r for r in rows if r[0] == "M"], [r for r in rows if r[0] != "M"][50:]]
    stream = GroupStream(str(tmp_path), block_rows=16)
    for k, part in enumerate(parts):
        stream.process(spark.createDataFrame(part, SCHEMA), k)
        if not k:
            assert stream.late(spark).count() == 0
    got = {(r.library_id, r.asset_id, r.group_id) for r in stream.members(spark).collect()}
    assert got == {(r.library_id, r.asset_id, r.group_id) for r in similarity.dup_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r.library_id for r in spark.read.parquet(f"{tmp_path}/tail/{1:012d}").collect()} == {"L", "M"}


def test_review_state_is_written_for_named_assets_only(spark, tmp_path):
    schema = "seq bigint, asset_id string, media_type string, action string"
    stream = ReviewStream(str(tmp_path))
    stream.process(spark.createDataFrame([(k, f"p{k}", "photo", "delete") for k in range(50)], schema), 0)
    stream.process(spark.createDataFrame([(60, "p1", "photo", "undo"), (61, None, "photo", "confirm")], schema), 1)
    assert spark.read.parquet(f"{tmp_path}/state/{1:012d}").count() == 1
    state = {r.asset_id: r for r in stream.state(spark).collect()}
    assert len(state) == 50 and not any(r.in_delete_queue for r in state.values())
    assert [k for k, r in state.items() if not r.processed] == ["p1"]


def test_stored_review_state_is_no_single_sort_key(spark):
    from photofold.plans.ordering import sorted_parts

    rows = spark.range(40_000).selectExpr("-1L AS seq", "concat('v', id) AS asset_id")
    with_parts = sorted_parts(rows.repartition(8), ["seq", "asset_id"])
    sizes = [r["count"] for r in with_parts.groupBy("_part").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_review_batch_by_batch(spark, tmp_path):
    log = random_log(5, 200)
    schema = "library_id string, seq bigint, asset_id string, media_type string, action string"
    write_parts(spark, log, schema, f"{tmp_path}/in", 50)
    stream = ReviewStream(f"{tmp_path}/out")
    files = ingest.read_new_files(spark, f"{tmp_path}/in/*", schema, files_per_trigger=1)
    ingest.run_available(stream.start(files))
    assert flags(stream.state(spark, 3).collect()) == replay(log)


def test_upsert_log_resumes(spark, tmp_path):
    schema = "asset_id string, seq bigint, width int, status int"
    base = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "asset_id string, width int, status int")

    def run():
        updates = ingest.read_new_files(spark, f"{tmp_path}/in/*", schema)
        ingest.run_available(stream_catalog.stream_upsert(updates, f"{tmp_path}/out"))
        log = spark.read.parquet(f"{tmp_path}/out/log")
        return log, {r.asset_id: (r.width, r.status) for r in stream_catalog.current_catalog(base, log).collect()}

    write_parts(spark, [("a", 1, 9, None)], schema, f"{tmp_path}/in", 1)
    assert run()[1] == {"a": (9, 0), "b": (2, 1)}
    write_parts(spark, [("x", 0, 0, 0), ("c", 2, None, 2), ("a", 3, None, 1)][1:], schema, f"{tmp_path}/in", 5)
    log, got = run()
    assert got == {"a": (9, 1), "b": (2, 1), "c": (None, 2)} and log.count() == 3


def test_compaction_keeps_later_changes(spark, tmp_path):
    schema = "asset_id string, seq bigint, width int, status int"
    base = spark.createDataFrame([("a", 1, 1)], "asset_id string, width int, status int")
    table = stream_catalog.CompactedCatalog(str(tmp_path))
    table.start(base)
    log = spark.createDataFrame([("a", 1, 9, None), ("b", 2, 3, 1)], schema)
    table.compact(spark, log)
    table.compact(spark, log)  # nothing new
    later = log.union(spark.createDataFrame([("a", 3, 50, 1)], schema))
    for _ in range(2):
        got = {r.asset_id: (r.width, r.status) for r in table.current(spark, later).collect()}
        assert got == {"a": (50, 1), "b": (3, 1)}
        table.compact(spark, later)
    assert len(list((tmp_path / "base").iterdir())) == 3


def test_ingest_files_and_counts(spark, tmp_path):
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "a.jpg").write_bytes(b"x" * 300)
    (tmp_path / "media" / "b.MP4").write_bytes(b"y")
    files = {r.uri.rsplit("/", 1)[1]: r for r in media.read_media_files(spark, f"{tmp_path}/media").collect()}
    assert files["b.MP4"].media_type == "video" and files["a.jpg"].media_type == "photo"
    assert files["a.jpg"].file_signature == f"{files['a.jpg'].mtime}_300"
    rows = spark.createDataFrame([(None, 3, True), (5, None, True), (5, 6, False)], "m bigint, s bigint, e boolean")
    texts = [r[0] for r in rows.select(media.file_signature("m", "s", F.col("e"))).collect()]
    assert texts == ["0_3", "5_0", ""]

    schema = "asset_id string, content binary"
    write_parts(spark, [("a", bytearray(b"abc")), ("b", None)], schema, f"{tmp_path}/in", 1)
    images = ingest.read_new_files(spark, f"{tmp_path}/in/*", schema, files_per_trigger=1)
    ingest.run_available(ingest.stream_ingest(images, f"{tmp_path}/scan"))
    results = spark.read.parquet(f"{tmp_path}/scan/results")
    assert {r.asset_id: r.status for r in results.collect()} == {"a": 1, "b": 2}
    again = ingest.read_new_files(spark, f"{tmp_path}/scan/results", results._jdf.schema().toDDL())
    status = ingest.StatusStream(f"{tmp_path}/status")
    ingest.run_available(status.start(again))
    assert {r.status: r["count"] for r in status.counts(spark).collect()} == {1: 1, 2: 1}


def test_status_counts_an_asset_once(spark, tmp_path):
    stream = ingest.StatusStream(str(tmp_path))
    schema = "library_id string, asset_id string, status int"
    stream.process(spark.createDataFrame([("L", "a", 0), ("L", "b", 0), ("M", "a", 2)], schema), 0)
    for _ in range(2):  # a repeated batch replaces its output
        stream.process(spark.createDataFrame([("L", "a", 1)], schema), 1)
    assert sorted(tuple(r) for r in stream.counts(spark).collect()) == [("L", 0, 1), ("L", 1, 1), ("M", 2, 1)]


def test_watermark_keeps_one_row_per_asset(spark, tmp_path):
    schema = "asset_id string, taken_at bigint"
    write_parts(spark, [("a", 5_000), ("a", 5_000), ("b", 6_000)], schema, f"{tmp_path}/in", 1)
    rows = ingest.read_new_files(spark, f"{tmp_path}/in/*", schema)
    once = ingest.on_time_assets(rows, "10 seconds").drop("taken_time")
    writer = once.writeStream.format("parquet").option("path", f"{tmp_path}/out")
    ingest.run_available(writer.option("checkpointLocation", f"{tmp_path}/cp"))
    assert sorted(r.asset_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_reports_are_written_per_library(spark, tmp_path):
    report = review.total_counts(
        spark.createDataFrame([("L", "a", "photo"), ("M", "b", "video")],
                              "library_id string, asset_id string, media_type string")
    )
    media.write_report(report, f"{tmp_path}/report")
    assert (tmp_path / "report" / "library_id=L").is_dir()
    assert spark.read.parquet(f"{tmp_path}/report").count() == 2


@pytest.mark.parametrize("files", [0, 1, 3])
def test_ingest_query_takes_a_table_of_one_file_or_many(spark, tmp_path, files):
    table = tmp_path / "documents.parquet"
    docs = spark.range(30 if files else 0).selectExpr("id AS doc_id", "repeat('text ', 50) AS text", "'en' AS lang", "'s' AS source", "250L AS n_chars")
    docs.repartition(files or 1).write.parquet(str(table if files != 1 else tmp_path / "one"))
    if files == 1:
        next((tmp_path / "one").glob("part-*.parquet")).rename(table)
    assert table.is_file() == (files == 1)
    got = registry.stream_ingest(spark, str(tmp_path)).collect()
    assert sorted(r.asset_id for r in got) == sorted(f"d{k}" for k in range(30 if files else 0))
    assert all(r.status == 1 and r.phash for r in got)
