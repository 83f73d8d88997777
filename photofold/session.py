"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("photofold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="photofold-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for this application below the shared one."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Later steps read only the columns they need; rows may come back in any order.
    """
    path = run_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def child_folders(spark: SparkSession, path: str, with_file: str | None = None) -> list[str]:
    """Names of the folders in a folder, if any, that hold a file of the given name."""
    where, system = _file_system(spark, path)
    if not system.exists(where):
        return []
    found = [s.getPath() for s in system.listStatus(where) if s.isDirectory()]
    held = [p for p in found if with_file is None or system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, with_file))]
    return sorted(p.getName() for p in held)


def remove_folder(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``cut_lineage`` and a function that removes the table, for when nothing reads it any more."""
    spark, path = df.sparkSession, run_folder(df.sparkSession, "cut")
    df.write.parquet(path)

    return spark.read.schema(df.schema).parquet(path), lambda: remove_folder(spark, path)


def cut_lineage_in_order(df: DataFrame) -> DataFrame:
    """The same by ``checkpoint()``, which keeps partitions and the order within them."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
