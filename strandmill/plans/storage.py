"""Written intermediate tables: in the folder that the cluster shares, so that a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000  # of some tens of bytes; larger tables are joined by a shuffle


def is_local(spark: SparkSession) -> bool:
    """Whether the driver and all tasks are one process, which sees one file system."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the cluster's spark.checkpoint.dir. Only in local mode a temporary one will do, removed at exit."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles(spark: SparkSession, n: int):
    """While the block writes something: at least n partitions in every exchange, none joined, where n is more than the session has."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in names}
    try:
        if n > int(before[names[0]]):
            spark.conf.set(names[0], str(n))
            spark.conf.set(names[1], "false")
        yield
    finally:
        for k, v in before.items():
            if spark.conf.get(k) != v:
                spark.conf.set(k, v)


def small(table: DataFrame) -> DataFrame:
    """table, marked for broadcast where its counted rows allow it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
