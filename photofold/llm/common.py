"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photofold.session import cut_lineage

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whole texts are long: Spark hands them to Python workers in batches of so many bytes at most, or one row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's size of Arrow batches, which counts for each task on both sides, if it is larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(now[:-1]) * units[now[-1]] if now[-1] in units else int(now)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text`` with null as the empty text; other columns are left behind."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def task_count(df: DataFrame) -> int:
    """Partitions for data that is dealt out anew: those of the session's shuffles."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterable, most_bytes: int, column: str = "text") -> Iterator:
    """Arrow batches cut so that ``column`` holds at most ``most_bytes``, or one row if that has more."""
    for batch in batches:
        sizes = [n or 0 for n in _lengths(batch.column(batch.schema.get_field_index(column)))]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _lengths(column) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def text_tag(text: Column) -> Column:
    """A hash of the text that tells rows with one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_tag(docs: DataFrame) -> Column:
    """The same of all columns that Spark can hash."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def pick_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` by ``doc_id`` and ``row_tag``, each ``copies`` times; all columns are kept.

    ``wanted`` is small beside the texts: ``doc_id``, ``tag``, ``rows`` (how many rows have this name) and ``copies``. Rows of one name,
    which are equal, are taken as one. Names that more than one row has are looked for first, and only their rows are made distinct.
    """
    wanted = cut_lineage(wanted.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "rows", "copies"))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), row_tag(docs).alias("tag")
    )
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))

    def found(names: DataFrame) -> DataFrame:
        return whole.join(names, on).select("row", "id", "tag", "copies")

    out = found(wanted.filter("rows = 1"))
    repeated = wanted.filter("rows > 1")
    if not repeated.isEmpty():
        out = out.union(found(repeated).dropDuplicates(["id", "tag"]))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
