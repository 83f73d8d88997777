"""Streams whose state is kept by key in Spark's state store, so that a batch costs what is in it.

State is read where it lies, by the ``statestore`` source over the checkpoint; no batch reads what earlier ones wrote.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.types import StructType

from photofold.config import SimilarityConfig
from photofold.functions.labels import group_id
from photofold.operators.groups import score_assets
from photofold.operators.review import (
    CLEARS_COLLECTION,
    CLEARS_DELETE,
    CLEARS_TRASH,
    MARKS_PHOTO,
    MARKS_VIDEO,
)
from photofold.operators.similarity import as_members, to_group
from photofold.plans.hot_keys import join_small
from photofold.schemas import LIBRARY, library_keys

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "_clock"
SHARD = "_shard"
#: Parts that the keys of a stream are dealt into where a part's state is one value; a stream keeps the number it began with.
SHARDS = 256


def keyed_state(spark: SparkSession) -> None:
    """Keep state in RocksDB, which state by key needs; streams that were started before stay with what they have."""
    spark.conf.set(PROVIDER, ROCKS)


def shard_of(keys: Sequence[str], shards: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")


def with_clock(rows: DataFrame, time: Column, delay: str) -> DataFrame:
    """A watermark that lets all rows pass, however late.

    Each row comes a second time with its time, which moves the watermark and goes no further; the rows that do have no time that
    could be late. Stateful operators then see the watermark and decide themselves.
    """
    none = F.lit(None).cast("timestamp")
    twice = rows.withColumn(CLOCK, F.explode(F.when(time.isNull(), F.array(none)).otherwise(F.array(none, time))))
    return twice.withWatermark(CLOCK, delay).filter(F.col(CLOCK).isNull())


def stored_state(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    reader = spark.read.format("statestore")
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)


def once(writer: DataFrame, path: str, by: str | None = None) -> None:
    """Write a batch of a stateful query in one go: a second action on it would run the operator again."""
    out = writer.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


# Late rows


def _hashable(value):
    """A key's value as Python compares it, equal where Spark groups equal."""
    if isinstance(value, (list, tuple)):
        return tuple(map(_hashable, value))
    if isinstance(value, bytearray):
        return bytes(value)
    return "NaN" if value != value else value


class _Arrivals(StatefulProcessor):
    """The first row of a key within the watermark. The keys of a shard that rows can still repeat are one value, read and written once a
    batch; it goes by a timer when there are none."""

    def __init__(self, keys: Sequence[str], time: str, delay_ms: int):
        self.keys, self.time, self.delay_ms = list(keys), time, delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "until_by_key binary")

    def _known(self, watermark: int) -> dict[tuple, int]:
        kept = pickle.loads(bytes(self.live.get()[0])) if self.live.exists() else {}
        return {key: until for key, until in kept.items() if until >= watermark}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        live, newest = self._known(watermark), None
        for row in rows:
            values = row.asDict()
            values.pop(CLOCK)
            values.pop(SHARD)
            at = values[self.time]
            if at is None:
                arrival = "undated"
            elif at < watermark:
                arrival = "late"
            elif (own := tuple(_hashable(values[k]) for k in self.keys)) in live:
                arrival = "repeat"
            else:
                arrival, live[own] = "on_time", at + self.delay_ms
                newest = live[own] if newest is None else max(newest, live[own])
            yield Row(**values, arrival=arrival)
        if newest is not None:
            self.handle.registerTimer(newest)
            self.live.update((pickle.dumps(live),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        live = self._known(timerValues.getCurrentWatermarkInMs())
        if live:
            self.live.update((pickle.dumps(live),))
        else:
            self.live.clear()
        yield from ()

    def close(self) -> None:
        pass


@dataclass
class Arrivals:
    """Every row of a stream under how it came: ``on_time`` (each key once within the watermark), ``repeat``, ``late`` (older than the newest
    time of earlier batches by more than the delay) or ``undated``.

    ``time`` names a column of milliseconds. All rows come out again, in the table of one of the four. Keys are dealt into ``shards``, whose
    state is one value: a batch costs its rows and the keys within the watermark of the shards it hits, not a call to the state store per key.
    """

    folder: str
    keys: Sequence[str]
    time: str
    delay_ms: int = 0
    shards: int = SHARDS

    def process(self, batch: DataFrame, batch_id: int) -> None:
        once(batch, f"{self.folder}/rows/batch={batch_id}", "arrival")

    def start(self, rows: DataFrame) -> DataStreamWriter:
        keyed_state(rows.sparkSession)
        schema = StructType(rows.schema.fields).add("arrival", "string")
        dealt = rows.withColumn(SHARD, shard_of(self.keys, self.shards))
        timed = with_clock(dealt, F.timestamp_millis(self.time), f"{self.delay_ms} milliseconds")
        told = timed.groupBy(SHARD).transformWithState(_Arrivals(self.keys, self.time, self.delay_ms), schema, "Update", "EventTime")
        return told.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.process)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows").drop("batch")


# Status counters

#: Below all numbers that a status can be.
NO_STATUS = -(1 << 40)


LATEST = ["timed", "at", "known", "status"]


class _LastStatus(StatefulProcessor):
    """Steps of the counters of a shard: less by the assets' old statuses, more by their new. The last statuses of its assets are one value,
    an Arrow table, read and written once a batch."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "statuses binary")

    def _stored(self) -> pd.DataFrame | None:
        if not self.last.exists():
            return None
        with pa.ipc.open_stream(bytes(self.last.get()[0])) as reader:
            return reader.read_pandas()

    def _store(self, rows: pd.DataFrame) -> None:
        table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.last.update((out.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [*self.keys, "asset_id"]
        new, old = pd.concat(list(rows), ignore_index=True)[[*names, *LATEST]], self._stored()
        known = 0 if old is None else len(old)
        both = new if old is None else pd.concat([old, new], ignore_index=True)
        asset = np.zeros(len(both), np.int64)
        for name in names:
            codes, values = pd.factorize(both[name], use_na_sentinel=False)
            asset = pd.factorize(asset * len(values) + codes)[0]
        order = np.lexsort([*(both[c].to_numpy() for c in reversed(LATEST)), asset])
        last = order[np.append(np.diff(asset[order]) != 0, True)]  # one place for each asset, in order of its number
        before = np.full(len(last), -1)
        before[asset[:known]] = np.arange(known)
        now, had = both.iloc[last], before >= 0
        # A missing status counts as one of its own.
        status = np.where(both["known"], both["status"], NO_STATUS)
        changed = ~had | (status[last] != status[before])
        steps = pd.concat([pd.DataFrame({**{k: now[k].to_numpy() for k in self.keys}, "status": status[at], "step": step})[which]
                           for at, step, which in ((last, 1, changed), (before, -1, changed & had))])
        summed = steps.groupby([*self.keys, "status"], dropna=False, as_index=False)["step"].sum()
        self._store(now)
        summed = summed[summed["step"] != 0]
        none = summed["status"] == NO_STATUS
        yield summed.assign(status=summed["status"].astype("Int64").mask(none).astype("Int32"), step=summed["step"].astype("int32"))[[*self.keys, "status", "step"]]

    def close(self) -> None:
        pass


@dataclass
class StatusCounters:
    """Number of assets by their last status (by ``updated_at``; ties by status), kept up step by step.

    Rows have ``asset_id``, ``status``, ``updated_at`` and maybe ``library_id``. One stream turns them into steps (``steps``), summed by shard
    and status, a second adds the steps up; its changed counters are in ``totals/<batch>``. ``run`` takes what has arrived through both.

    Assets are dealt into ``shards``, whose state is one value: a batch costs its rows and the assets of the shards it hits.
    """

    folder: str
    libraries: bool = False
    shards: int = SHARDS

    def steps(self, results: DataFrame) -> DataStreamWriter:
        keyed_state(results.sparkSession)
        keys = [LIBRARY] if self.libraries else []
        schema = "".join(f"{k} string, " for k in keys) + "status int, step int"
        status, at = F.col("status"), F.col("updated_at").cast("bigint")
        rows = results.select(
            *keys, "asset_id", at.isNotNull().alias("timed"), F.coalesce(at, F.lit(0)).alias("at"), status.isNotNull().alias("known"),
            F.coalesce(status, F.lit(0)).cast("int").alias("status"), shard_of([*keys, "asset_id"], self.shards).alias(SHARD),
        )
        told = rows.groupBy(SHARD).transformWithStateInPandas(_LastStatus(keys), StructType.fromDDL(schema), "Append", "None")
        writer = told.writeStream.outputMode("append").format("parquet").option("path", f"{self.folder}/steps")
        return writer.option("checkpointLocation", f"{self.folder}/steps_checkpoint")

    def totals(self, spark: SparkSession) -> DataStreamWriter:
        keys = [LIBRARY] if self.libraries else []
        schema = "".join(f"{k} string, " for k in keys) + "status int, step int"
        read = spark.readStream.schema(schema).parquet(f"{self.folder}/steps")
        summed = read.groupBy(*keys, "status").agg(F.sum("step").alias("count"))
        writer = summed.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/totals_checkpoint")
        return writer.foreachBatch(lambda batch, n: once(batch, f"{self.folder}/totals/{n:012d}"))

    def run(self, results: DataFrame) -> None:
        for writer in (lambda: self.steps(results), lambda: self.totals(results.sparkSession)):
            writer().trigger(availableNow=True).start().awaitTermination()

    def counts(self, spark: SparkSession) -> DataFrame:
        """The counters as they are, from the state of the second stream."""
        state = stored_state(spark, f"{self.folder}/totals_checkpoint")
        value = state.schema["value"].dataType.names[0]
        counted = state.select("key.*", F.col(f"value.`{value}`").alias("count"))
        return counted.filter("count > 0")


# Review state

LAST = "marked bigint, undo bigint, deleted bigint, collected bigint, trashed bigint, tried bigint, restored bigint"
CLEARED = "deletions bigint, collections bigint, trash bigint, progress bigint"
FLAGS = "processed boolean, in_delete_queue boolean, in_collection_queue boolean, in_trash boolean, queued_at bigint"


def _after(a: int | None, *others: int | None) -> bool:
    return a is not None and all(b is None or a > b for b in others)


class _Review(StatefulProcessor):
    """The last time of each action by asset, and of each clearing action for all of them.

    A clearing changes no asset's entry: it is compared with them when they are read.
    """

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle) -> None:
        self.assets = handle.getMapState("assets", "asset_id string", LAST)
        self.cleared = handle.getValueState("cleared", CLEARED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [f.split()[0] for f in LAST.split(", ")]
        clears = list(self.cleared.get()) if self.cleared.exists() else [None] * 4
        own = dict(zip(self.keys, key))
        touched: dict[str, dict] = {}
        cleared = False
        for seq, asset, action in sorted(((r["seq"], r["asset_id"], r["action"]) for r in rows), key=lambda r: r[0]):
            if asset is None:
                for i, names_ in enumerate((CLEARS_DELETE, CLEARS_COLLECTION, CLEARS_TRASH, ["progress_reset"])):
                    if action in names_:
                        clears[i], cleared = seq, True
                continue
            if asset not in touched:
                known = tuple(self.assets.getValue((asset,))) if self.assets.containsKey((asset,)) else (None,) * len(names)
                touched[asset] = dict(zip(names, known))
            self._act(touched[asset], own["media_type"], seq, action, clears[2])
        if cleared:
            self.cleared.update(tuple(clears))
        for asset, last in touched.items():
            self.assets.updateValue((asset,), tuple(last[n] for n in names))
            yield Row(**{k: v for k, v in own.items() if k != "shard"}, asset_id=asset, **self._flags(own["media_type"], last, clears))

    @staticmethod
    def _act(last: dict, media: str, seq: int, action: str, trash_cleared: int | None) -> None:
        if media == "photo":
            if action in MARKS_PHOTO:
                last["marked"] = seq
            if slot := {"undo": "undo", "delete": "deleted", "collect": "collected"}.get(action):
                last[slot] = seq
            return
        if action in MARKS_VIDEO:
            last["marked"] = seq
        if action == "trash":
            last["trashed"] = seq
        elif action == "restore":
            # It works on what the last move put into the trash, unless the trash was cleared since.
            if _after(last["trashed"], last["tried"], trash_cleared):
                last["restored"] = seq
            last["tried"] = seq

    @staticmethod
    def _flags(media: str, last: dict, clears: Sequence[int | None]) -> dict:
        deletions, collections, trash, progress = clears
        photo = media == "photo"
        queued = photo and _after(last["deleted"], last["undo"], deletions)
        return {
            "processed": _after(last["marked"], last["undo"] if photo else last["restored"], progress),
            "in_delete_queue": queued,
            "in_collection_queue": photo and _after(last["collected"], last["undo"], collections),
            "in_trash": not photo and _after(last["trashed"], last["tried"], trash),
            "queued_at": last["deleted"] if queued else None,
        }

    def close(self) -> None:
        pass


@dataclass
class KeyedReview:
    """Review state of every asset; batches come in ``seq`` order.

    Assets are dealt into ``shards`` per library and media type, whose state is a map by asset, so a hot library is many keys; a global action
    goes to all of them. ``changes/<batch>`` has the assets that a batch names, as they then are.
    """

    folder: str
    libraries: bool = False
    shards: int = 16

    def __post_init__(self) -> None:
        self._keys = [*([LIBRARY] if self.libraries else []), "media_type"]

    def start(self, events: DataFrame) -> DataStreamWriter:
        keyed_state(events.sparkSession)
        own = F.array(F.pmod(F.xxhash64("asset_id"), F.lit(self.shards)).cast("int"))
        every = F.sequence(F.lit(0), F.lit(self.shards - 1))
        rows = events.filter(F.col("media_type").isin("photo", "video")).select(
            *self._keys, "seq", "asset_id", "action", F.explode(F.when(F.col("asset_id").isNull(), every).otherwise(own)).alias("shard")
        )
        kinds = "".join(f"{k} string, " for k in self._keys)
        told = rows.groupBy(*self._keys, "shard").transformWithState(
            _Review([*self._keys, "shard"]), StructType.fromDDL(f"{kinds}asset_id string, {FLAGS}"), "Update", "None"
        )
        writer = told.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.foreachBatch(lambda batch, n: once(batch, f"{self.folder}/changes/{n:012d}"))

    def state(self, spark: SparkSession) -> DataFrame:
        """The state of all assets after the last batch."""
        checkpoint = f"{self.folder}/checkpoint"
        assets = stored_state(spark, checkpoint, "assets").select("key.*", "user_map_key.asset_id", "user_map_value.*")
        clears = stored_state(spark, checkpoint, "cleared").select("key.*", "value.*")
        both = join_small(assets, clears, [*self._keys, "shard"], "left")
        photo = F.col("media_type") == "photo"

        def after(column: str, *others: Column) -> Column:
            latest = F.greatest(*others) if len(others) > 1 else others[0]
            return F.coalesce(F.col(column) > latest, F.col(column).isNotNull())

        undone = F.when(photo, F.col("undo")).otherwise(F.col("restored"))
        queued = photo & after("deleted", F.col("undo"), F.col("deletions"))
        return both.select(
            *self._keys, "asset_id", after("marked", undone, F.col("progress")).alias("processed"), queued.alias("in_delete_queue"),
            (photo & after("collected", F.col("undo"), F.col("collections"))).alias("in_collection_queue"),
            (~photo & after("trashed", F.col("tried"), F.col("trash"))).alias("in_trash"), F.when(queued, F.col("deleted")).alias("queued_at"),
        )


# Duplicate groups

GROUPED = "kind string, asset_id string, taken_at bigint, root_id string, distance_to_parent int, best_asset_id string, score double"
TAIL = "asset_id string, taken_at bigint, bits bigint, usable boolean, root_id string, best_asset_id string, score double"


class _Groups(StatefulProcessor):
    """Groups of one library: the last rows of the look-back with their roots, and how far the time line came.

    The rows go by a timer when no new asset can lie within the window any more.
    """

    def __init__(self, config: SimilarityConfig, keys: Sequence[str]):
        self.config, self.keys = config, list(keys)

    def init(self, handle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", TAIL)
        self.cursor = handle.getValueState("cursor", "taken_at bigint, asset_id string, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in TAIL.split(", ")]
        new = pd.concat(list(rows), ignore_index=True).sort_values(["taken_at", "asset_id"], ignore_index=True)
        if self.cursor.exists():
            at, last, timer = self.cursor.get()
            late = (new["taken_at"] < at) | ((new["taken_at"] == at) & (new["asset_id"] <= last))
            if late.any():
                yield self._told(key, new[late], "late")
            new = new[~late].reset_index(drop=True)
            if not len(new):
                return
            self.handle.deleteTimer(timer)
        tail = pd.DataFrame([tuple(r) for r in self.tail.get()], columns=names)
        back = max(self.config.max_compare_count - 1, 0)
        both = pd.concat([tail, new.assign(root_id=None, best_asset_id=None)[names]], ignore_index=True) if len(tail) else new.assign(root_id=None, best_asset_id=None)[names]
        n, known = len(both), len(tail)
        time, bits, usable = both["taken_at"].to_numpy(np.int64), both["bits"].to_numpy(np.int64), both["usable"].to_numpy(bool)
        best = np.full(n, np.iinfo(np.int64).max)
        for k in range(1, min(back, n - 1) + 1):
            distance = np.bitwise_count((bits[k:] ^ bits[:-k]).view(np.uint64)).astype(np.int64)
            near = usable[k:] & usable[:-k] & (time[k:] - time[:-k] <= self.config.window_ms) & (distance < self.config.similar_threshold)
            best[k:] = np.minimum(best[k:], np.where(near, distance * (back + 1) + k, best[k:]))
        best[:known] = np.iinfo(np.int64).max
        linked = best < np.iinfo(np.int64).max
        parent = np.arange(n) - np.where(linked, best % (back + 1), 0)
        while not np.array_equal(further := parent[parent], parent):
            parent = further
        ids = both["asset_id"].to_numpy(object)
        roots = np.where(parent < known, both["root_id"].to_numpy(object)[parent], ids[parent])
        roots[:known] = both["root_id"].to_numpy(object)[:known]
        both["root_id"] = roots
        # The best shot of each group touched: of its members here and of the best before.
        score = both["score"].to_numpy(float)
        by = ids.copy()
        by[:known] = both["best_asset_id"].to_numpy(object)[:known]
        counted = pd.DataFrame({"root_id": roots, "score": score, "best_asset_id": by})[usable].sort_values(
            ["root_id", "score", "best_asset_id"], ascending=[True, False, True]
        )
        top = counted.drop_duplicates("root_id").set_index("root_id")
        both["best_asset_id"] = both["root_id"].map(top["best_asset_id"])
        both["score"] = both["root_id"].map(top["score"])
        fresh = both.iloc[known:].assign(distance_to_parent=pd.array(np.where(linked, best // (back + 1), -1), dtype="Int32")[known:])
        fresh.loc[~linked[known:], "distance_to_parent"] = pd.NA
        members = fresh[usable[known:]]
        yield self._told(key, members, "member")
        yield self._told(key, members.drop_duplicates("root_id"), "group")
        last = both.tail(back)
        if back:
            self.tail.put([tuple(None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in last.itertuples(index=False)])
        timer = int(time[-1]) + self.config.window_ms + 1
        self.handle.registerTimer(timer)
        self.cursor.update((int(time[-1]), ids[-1], timer))

    def _told(self, key: tuple, rows: pd.DataFrame, kind: str) -> pd.DataFrame:
        wanted = {"late": ["asset_id", "taken_at"], "member": ["asset_id", "taken_at", "root_id", "distance_to_parent"], "group": ["root_id", "best_asset_id", "score"]}[kind]
        out = pd.DataFrame({name: value for name, value in zip(self.keys, ([k] * len(rows) for k in key))})
        out["kind"] = kind
        kinds = {"string": "object", "bigint": "Int64", "int": "Int32", "double": "Float64"}
        for name, ddl in (f.split() for f in GROUPED.split(", ")[1:]):
            values = rows[name].array if name in wanted else [None] * len(rows)
            out[name] = pd.array(values, dtype=kinds[ddl]) if ddl != "string" else pd.Series(list(values), dtype=object)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tail.clear()
        yield from ()

    def close(self) -> None:
        pass


@dataclass
class KeyedGroups:
    """Group assignment of many libraries side by side, with their best shots; a library is one key.

    A task holds the new assets of one library of one batch, a few numbers each, so the files taken per batch bound it; for a single
    huge library ``GroupStream`` works in parallel within it. Assets at or before the newest of their library come out as late.
    """

    folder: str
    config: SimilarityConfig = field(default_factory=SimilarityConfig)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        once(batch, f"{self.folder}/rows/batch={batch_id}", "kind")

    def start(self, assets: DataFrame) -> DataStreamWriter:
        """Writer for a stream of catalog rows with ``library_id``, in rough time order, one row per asset."""
        keyed_state(assets.sparkSession)
        wanted = to_group(score_assets(assets), ["score"])
        usable = F.col("_bits").isNotNull()
        rows = wanted.select(
            LIBRARY, "asset_id", "taken_at", F.coalesce("_bits", F.lit(0).cast("bigint")).alias("bits"), usable.alias("usable"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
        timed = with_clock(rows, F.timestamp_millis("taken_at"), "0 seconds")
        told = timed.groupBy(LIBRARY).transformWithStateInPandas(
            _Groups(self.config, [LIBRARY]), StructType.fromDDL(f"{LIBRARY} string, {GROUPED}"), "Update", "EventTime"
        )
        return told.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.process)

    def _kind(self, spark: SparkSession, kind: str) -> DataFrame:
        schema = StructType.fromDDL(f"{LIBRARY} string, {GROUPED}, batch bigint")
        return spark.read.schema(schema).parquet(f"{self.folder}/rows").filter(F.col("kind") == kind)

    def members(self, spark: SparkSession) -> DataFrame:
        return as_members(self._kind(spark, "member").select(LIBRARY, "asset_id", "root_id", "distance_to_parent"))

    def late(self, spark: SparkSession) -> DataFrame:
        return self._kind(spark, "late").select(LIBRARY, "asset_id", "taken_at")

    def best(self, spark: SparkSession) -> DataFrame:
        """Best shot of each group so far."""
        rows = self._kind(spark, "group")
        top = rows.groupBy(LIBRARY, "root_id").agg(F.min(F.struct((-F.col("score")).alias("by"), "best_asset_id")).alias("top"))
        by = (-F.col("top.by")).alias("score")
        return top.select(LIBRARY, group_id(LIBRARY, "root_id").alias("group_id"), F.col("top.best_asset_id").alias("best_asset_id"), by)
