"""Helpers shared by the corpus operators: checkpoints, global order, copies of equal rows."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# A table is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000
# Copies of one row are unfolded in lists of at most this many.
COPIES_PER_LIST = 1024


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read back.

    Later jobs neither recompute it nor depend on the executor that made it. Only a
    session without that setting and without a folder of its own (tests) gets a
    temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return df.checkpoint(eager=True)


def small_or_not(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already checkpointed) with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= most else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def running_starts(df: DataFrame, order: Sequence[str], weight: str, name: str = "start") -> DataFrame:
    """Adds the sum of ``weight`` over all rows that precede a row in the order of ``order``.

    ``order`` must identify the rows. The rows are dealt into ranges of the order, which
    are sorted side by side; only one sum per range is added up in a single task. The
    outcome depends on the order alone, not on where the ranges happen to be cut.
    """
    ranged = checkpointed(
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id())
    )
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(below), F.lit(0)).alias("_offset"))
    before = (
        Window.partitionBy("_range")
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per range: as many as shuffle partitions.
    placed = ranged.join(F.broadcast(offsets), "_range")
    inside = F.coalesce(F.sum(weight).over(before), F.lit(0))
    return placed.withColumn(name, F.col("_offset") + inside).drop("_range", "_offset")


def unfolded(df: DataFrame, copies: str, index: str) -> DataFrame:
    """Every row ``copies`` times, numbered from 0 in ``index``; no list holds over 1,024."""
    lists = F.expr(f"sequence(0L, greatest(({copies} - 1) div {COPIES_PER_LIST}, 0L))")
    inner = F.expr(
        f"sequence(_list * {COPIES_PER_LIST}L, least((_list + 1) * {COPIES_PER_LIST}L, {copies}) - 1)"
    )
    return (
        df.where(F.col(copies) > 0)
        .withColumn("_list", F.explode(lists))
        .withColumn(index, F.explode(inner))
        .drop("_list", copies)
    )


def in_batches(df: DataFrame, rows: int = 2000, size: str = "8m") -> DataFrame:
    """``df``, with Arrow batches bounded in rows and bytes, since texts may be very long."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), whatever other columns ``docs`` has."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
