"""Session settings for cluster runs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

CLUSTER_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def build_session(
    app_name: str = "tidemark",
    master: str | None = None,
    shuffle_partitions: int = 2000,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution on.

    ``shuffle_partitions`` is the number adaptive execution starts from and merges down
    from; size it so that the largest shuffle divided by it fits a task.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**CLUSTER_SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions)}
    for name, value in {**settings, **(extra or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def small_frame(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """A few driver-built rows as a local relation: no job and no Python worker reads it."""
    records = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    Only a local session may do without ``spark.checkpoint.dir``: there a temporary folder is shared by all.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for many readers.

    With a shared checkpoint folder the rows are written there, so they survive the loss
    of an executor. Without one the rows are persisted and recomputed from their lineage
    where blocks are lost.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder:
        context = df.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# Rows that are fitted on are dealt into partitions of about this many.
FIT_ROWS = 16_384


def spread(df: DataFrame) -> DataFrame:
    """``df`` computed once, in partitions of about ``FIT_ROWS`` rows.

    Adaptive execution merges partitions by their bytes. Passes that work long on every row, as fits do, would
    then run in a task or two. A table in more partitions stays as it is.
    """
    held = materialise(df)
    wanted = -(-held.count() // FIT_ROWS)
    return materialise(held.repartition(wanted)) if held.rdd.getNumPartitions() < wanted else held


# A table is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` (materialised) with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
