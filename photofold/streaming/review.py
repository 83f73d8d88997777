"""Review state kept up to date from a stream of actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from photofold.operators.review import (
    CLEARS_COLLECTION,
    CLEARS_DELETE,
    CLEARS_TRASH,
    review_fold,
)
from photofold.plans.hot_keys import broadcast_if_fits, join_small
from photofold.schemas import library_keys
from photofold.session import cut_lineage


def as_events(state: DataFrame) -> DataFrame:
    """Actions that lead to ``state`` from nothing, dated before any real one.

    The flags decide all later behaviour, so folding these with new actions gives the
    same state as folding the whole log.
    """
    photo = F.col("media_type") == "photo"

    def action(condition, name: str):
        seq = F.coalesce("queued_at", F.lit(-1)) if name == "delete" else F.lit(-1)
        return F.when(
            condition,
            F.struct(F.lit(name).alias("action"), seq.cast("bigint").alias("seq")),
        )

    actions = F.array_compact(
        F.array(
            action(photo & F.col("processed"), "skip"),
            action(photo & F.col("in_delete_queue"), "delete"),
            action(photo & F.col("in_collection_queue"), "collect"),
            action(~photo & F.col("processed"), "processed"),
            action(~photo & F.col("in_trash"), "trash"),
            # Nothing set: an action without effect keeps the asset in the table.
            action(photo & ~F.col("processed"), "undo"),
            action(~photo & ~F.col("processed"), "restore"),
        )
    )
    keys = library_keys(state)
    return state.select(*keys, "asset_id", "media_type", F.explode(actions).alias("a")).select(
        *keys, F.col("a.seq").alias("seq"), "asset_id", "media_type", F.col("a.action").alias("action")
    )


FLAGS = ["processed", "in_delete_queue", "in_collection_queue", "in_trash"]
#: Which global actions take which flag away.
CLEARS = dict(zip(FLAGS, (["progress_reset"], CLEARS_DELETE, CLEARS_COLLECTION, CLEARS_TRASH)))


@dataclass
class ReviewStream:
    """Folds each batch of actions into the stored state; batches come in ``seq`` order.

    A batch writes the state of the assets that it names, and the global actions in it. An asset's state is its
    last row, less the flags that global actions of later batches took away.
    """

    folder: str

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/{batch_id:012d}"

    def _write(self, rows: DataFrame, table: str, batch_id: int) -> None:
        rows.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(self._path(table, batch_id))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        keys = library_keys(batch)
        events = cut_lineage(batch.select(*keys, "seq", "asset_id", "media_type", "action"))
        kinds = [F.max(F.col("action").isin(names)).alias(flag) for flag, names in CLEARS.items()]
        marks = events.filter("asset_id is null").groupBy(*keys, "media_type").agg(*kinds)
        self._write(marks, "marks", batch_id)
        if batch_id:
            ids = [*keys, "media_type", "asset_id"]
            named = events.filter("asset_id is not null").select(*ids).distinct()
            before = self._state(batch.sparkSession, batch_id, named)
            events = events.unionByName(as_events(before))
        self._write(review_fold(events), "state", batch_id)

    def _state(self, spark: SparkSession, before_batch: int, named: DataFrame | None = None) -> DataFrame:
        rows = spark.read.parquet(f"{self.folder}/state/*").filter(F.col("_batch") < before_batch)
        keys = library_keys(rows)
        ids = [*keys, "media_type", "asset_id"]
        if named is not None:
            rows = rows.join(broadcast_if_fits(named), ids, "left_semi")
        last = rows.groupBy(*ids).agg(F.max_by(F.struct(*FLAGS, "queued_at", "_batch"), "_batch").alias("s")).select(*ids, "s.*")
        marks = spark.read.parquet(f"{self.folder}/marks/*").filter(F.col("_batch") < before_batch)
        cleared = marks.groupBy(*keys, "media_type").agg(
            *[F.max(F.when(F.col(flag), F.col("_batch"))).alias(f"_{flag}") for flag in FLAGS]
        )
        joined = join_small(last, cleared, [*keys, "media_type"], "left")
        now = {f: F.col(f) & ~F.coalesce(F.col(f"_{f}") > F.col("_batch"), F.lit(False)) for f in FLAGS}
        queued = F.when(now["in_delete_queue"], F.col("queued_at")).alias("queued_at")
        return joined.select(*keys, "asset_id", "media_type", *[c.alias(f) for f, c in now.items()], queued)

    def start(self, events: DataFrame) -> DataStreamWriter:
        return events.writeStream.option(
            "checkpointLocation", f"{self.folder}/checkpoint"
        ).foreachBatch(self.process)

    def state(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """The state after a batch, or after the last one."""
        return self._state(spark, 1 << 62 if batch_id is None else batch_id + 1)
