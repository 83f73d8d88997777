import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photofold.config import SimilarityConfig
from photofold.operators import similarity
from photofold.streaming import ingest
from photofold.streaming.regroup import GroupTable, with_islands
from photofold.streaming.tables import BucketTable, hash_bucket
from test_similarity import SCHEMA, library


def members(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_islands_are_cut_at_long_gaps(spark):
    rows = [("L", f"{k:02d}", t) for k, t in enumerate([0, 5, 10, 21, 22, 40])] + [("M", "x", 41), ("M", "y", 51)]
    df = spark.createDataFrame(rows, "library_id string, asset_id string, taken_at bigint").repartition(5)
    numbers = {(r.library_id, r.taken_at): r._island for r in with_islands(df, 10).collect()}
    found = {}
    for key, n in numbers.items():
        found.setdefault(n, set()).add(key)
    assert sorted(map(sorted, found.values())) == [
        [("L", 0), ("L", 5), ("L", 10)], [("L", 21), ("L", 22)], [("L", 40)], [("M", 41), ("M", 51)]
    ]


@pytest.mark.parametrize("libraries", [False, True])
@pytest.mark.parametrize("libraries", [True])
def test_groups_after_random_changes(spark, tmp_path, libraries):
    r = random.Random(11)
    rows = {(x[0], x[1]): x for k in range(2 if libraries else 1) for x in library(60 + k, 160, name=f"L{k}")}
    later = {k: rows.pop(k) for k in r.sample(sorted(rows), 25)}
    strip = (lambda x: x) if libraries else (lambda x: x[1:])
    schema = SCHEMA if libraries else SCHEMA.split(", ", 1)[1]
    table = GroupTable(str(tmp_path), libraries=libraries, bucket_ms=600_000, id_buckets=8, block_rows=16)
    frame = lambda some: spark.createDataFrame([strip(x) for x in some], schema)
    table.first_run(frame(rows.values()))
    ids = ["library_id"] * libraries + ["asset_id"]
    columns = [*ids, "group_id", "representative_asset_id", "distance_to_parent"]
    known = {tuple(m[: len(ids)]): (m[-2], m[-1]) for m in members(table.members(spark), columns)}
    for batch in range(2):
        changes = {k: later.pop(k) for k in sorted(later)[:8]}
        for k in r.sample(sorted(rows), 12):
            name, asset, time, phash, status = rows[k]
            kind = r.randrange(4)
            if kind == 0:  # reset, or gone
                changes[k] = (name, asset, time, phash, 0)
            elif kind == 1 and time:  # another time
                changes[k] = (name, asset, time + r.choice([-500_000, -7, 7, 130_000]), phash, 1)
            elif kind == 2:  # another image
                changes[k] = (name, asset, time, f"{r.getrandbits(64):016x}", 1)
            else:  # as a neighbour
                changes[k] = (name, asset, time, r.choice(sorted(rows.values(), key=repr))[3], 1)
        rows |= changes
        for _ in range(2 if batch == 1 else 1):  # a repeated batch replaces its output
            table.apply(frame(changes.values()), batch)
        want = members(similarity.dup_groups(frame(rows.values()), SimilarityConfig()), columns)
        assert members(table.members(spark), columns) == want
        for step in table.changes(spark, batch).orderBy(F.desc("op")).collect():
            key = tuple(step[i] for i in ids)
            if step.op == "retract":
                assert known.pop(key) == (step.root_id, step.distance_to_parent)
            else:
                assert key not in known
                known[key] = (step.root_id, step.distance_to_parent)
        assert known == {tuple(m[: len(ids)]): (m[-2], m[-1]) for m in want}


def test_a_change_reads_and_writes_its_islands_only(spark, tmp_path):
    hour = 3_600_000
    rows = [(f"a{d:02d}{k}", d * 24 * hour + hour + k, "0" * 16, 1) for d in range(30) for k in range(3)]
    schema = SCHEMA.split(", ", 1)[1]
    table = GroupTable(str(tmp_path), bucket_ms=24 * hour)
    table.first_run(spark.createDataFrame(rows, schema))
    read = []
    taken = table.rows.read
    table.rows.read = lambda spark, buckets=None, at_most=None: read.append(buckets) or taken(spark, buckets, at_most)
    table.apply(spark.createDataFrame([("new", 5 * 24 * hour + hour + 1, "0" * 16, 1)], schema), 0)
    assert all(set(b) <= {5} for b in read)
    assert [p.name for p in (tmp_path / "rows/data" / f"{1:012d}").iterdir() if p.is_dir()] == ["_bucket=5"]
    table.rows.read = taken
    assert table.members(spark).count() == 91
    assert table.members(spark, 0).count() == 90


def test_stream_of_changes(spark, tmp_path):
    schema = SCHEMA.split(", ", 1)[1]
    table = GroupTable(f"{tmp_path}/t")
    table.first_run(spark.createDataFrame([("b", 2000, "0" * 16, 1), ("c", 300_000, "0" * 16, 1)], schema))
    for k, row in enumerate([("a", 1000, "0" * 16, 1), ("m", 150_000, "f" * 16, 1), ("b", 2000, "0" * 16, 0)]):
        spark.createDataFrame([row], schema).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.run_available(table.start(ingest.read_new_files(spark, f"{tmp_path}/in", schema)))
    assert {r.asset_id: r.group_id for r in table.members(spark).collect()} == {"a": "grp_a", "c": "grp_c", "m": "grp_m"}
    steps = [(r.op, r.asset_id, r.root_id) for r in table.changes(spark, 0).orderBy(F.desc("op"), "asset_id").collect()]
    assert steps == [("retract", "b", "b"), ("add", "a", "a"), ("add", "b", "a")]


def test_bucket_table_writes_what_changed(spark, tmp_path):
    schema = StructType.fromDDL("asset_id string, n bigint")
    table = BucketTable(str(tmp_path), schema)
    bucket = hash_bucket(["asset_id"], 8)
    rows = spark.createDataFrame([(f"a{k}", k) for k in range(200)], schema)
    table.write(rows, bucket, 0, note=7)
    assert table.buckets(spark) == list(range(8)) and table.note(spark) == 7
    changed = rows.filter(bucket.isin(2, 5)).withColumn("n", -F.col("n"))
    table.write(changed.filter(bucket == 2), bucket, 1, [2, 5])
    assert table.buckets(spark) == [0, 1, 2, 3, 4, 6, 7] and table.buckets(spark, 0) == list(range(8))
    written = {p.name for p in (tmp_path / "data" / f"{1:012d}").iterdir() if p.is_dir()}
    assert written == {"_bucket=2"}
    want = {(r.asset_id, -r.n if r.b == 2 else r.n) for r in rows.withColumn("b", bucket).collect() if r.b != 5}
    assert {tuple(r) for r in table.read(spark).collect()} == want
    assert {tuple(r) for r in table.read(spark, [2, 5]).collect()} == {w for w in want if w[1] < 0}
    table.vacuum(spark)
    assert {tuple(r) for r in table.read(spark).collect()} == want and table.newest(spark) == 1
    assert not (tmp_path / "data" / f"{0:012d}" / "_bucket=2").exists()
