"""Session construction shared by tests, bench and jobs."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


# For wide tables of entries: most of their texts differ, and looking each one up in a dictionary is what writing them costs.
PLAIN = {"parquet.enable.dictionary": "false"}


def build_session(app: str = "turnledger", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with AQE (coalescing, skew-join splitting) and UTC as the time zone.

    ``master`` and ``shuffle_partitions`` are left to the cluster unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor does not replay the whole iteration.

    The cluster names the shared folder in ``spark.checkpoint.dir``; a folder of our own is used only on a
    local master without that setting.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder; a temporary one only on a local master."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="turnledger-", dir=os.environ.get("TMPDIR", "/tmp"))
    return shared.rstrip("/")


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written or collected meanwhile are removed when that ends, not when the driver's garbage
    is collected. For frames that run once: a second run of the same one would work them out again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, folder: str | None = None, sweep: bool = False, **options: str) -> DataFrame:
    """Write a table that several later steps read and return a reader of it.

    Parquet keeps column pruning and filter push-down for the readers, and a lost executor re-reads the table
    instead of replaying the steps before it. ``folder`` is the shared folder unless given, ``options`` are those of the
    Parquet writer. ``sweep`` removes the shuffle files of the write with its end.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with swept(spark) if sweep else contextlib.nullcontext():
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate tables that nothing reads any more."""
    files, path = _at(spark, folder)
    files.delete(path, True)


def move(spark: SparkSession, folder: str, to: str) -> None:
    """Move a folder as a whole to a new place; an empty folder if there is none."""
    (files, path), (_, target) = _at(spark, folder), _at(spark, to)
    if not files.exists(path):
        files.mkdirs(target)
        return
    files.mkdirs(target.getParent())
    if not files.rename(path, target):
        raise OSError(f"cannot move {folder} to {to}")
