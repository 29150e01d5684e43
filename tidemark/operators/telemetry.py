"""Spark event logs and resource samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.joins import many_to_one

# Name of each total and the paths of its parts in a task-end event.
TASK_TOTALS = {
    "executor_run_ms": ["Executor Run Time"],
    "executor_cpu_ns": ["Executor CPU Time"],
    "jvm_gc_ms": ["JVM GC Time"],
    "memory_spill_bytes": ["Memory Bytes Spilled"],
    "disk_spill_bytes": ["Disk Bytes Spilled"],
    "shuffle_read_bytes": ["Shuffle Read Metrics.Remote Bytes Read", "Shuffle Read Metrics.Local Bytes Read"],
    "shuffle_write_bytes": ["Shuffle Write Metrics.Shuffle Bytes Written"],
    "input_bytes": ["Input Metrics.Bytes Read"],
    "output_bytes": ["Output Metrics.Bytes Written"],
}
TASK_END = "SparkListenerTaskEnd"
_BROKEN = "_broken"


def _event_schema() -> T.StructType:
    """The parts of a log line that are read, plus the text of lines that do not parse."""
    flat, nested = [], {}
    for path in (part for parts in TASK_TOTALS.values() for part in parts):
        head, _, leaf = path.partition(".")
        if leaf:
            nested.setdefault(head, []).append(T.StructField(leaf, T.DoubleType()))
        else:
            flat.append(T.StructField(head, T.DoubleType()))
    metrics = T.StructType(flat + [T.StructField(k, T.StructType(v)) for k, v in nested.items()])
    return T.StructType([
        T.StructField("Event", T.StringType()),
        T.StructField("Task End Reason", T.StructType([T.StructField("Reason", T.StringType())])),
        T.StructField("Task Metrics", metrics),
        T.StructField(_BROKEN, T.StringType()),
    ])


def task_rows(lines: DataFrame, run: str = "run_id", text: str = "value") -> DataFrame:
    """Task-end events as typed columns; malformed lines and other events are skipped.

    A well-formed event counts whatever its metrics are: a fractional one with its whole
    part, one that is missing or no number with 0. A value is read as a double, which is
    exact up to 2**53; sums are exact. A cheap substring test runs before any JSON is parsed. The parsed line is unpacked by a
    generator, below which no filter is pushed, so each line is parsed once.
    """
    ends = lines.where(F.contains(F.col(text), F.lit(TASK_END)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    parsed = ends.select(run, F.inline(F.array(F.from_json(F.col(text), _event_schema(), options))))
    # A line is also kept as broken where only a field does not fit its type.
    well_formed = F.col(_BROKEN).isNull() | F.try_parse_json(F.col(_BROKEN)).isNotNull()
    tasks = parsed.where(well_formed & (F.col("Event") == F.lit(TASK_END)))

    def number(paths: Sequence[str]) -> Column:
        total: Column | None = None
        for path in paths:
            value = F.col("Task Metrics")
            for name in path.split("."):
                value = value[name]
            value = F.coalesce(value.try_cast("long"), F.lit(0).cast("long"))
            total = value if total is None else total + value
        return total

    return tasks.select(
        run,
        F.when(F.col("Task End Reason")["Reason"] == F.lit("Success"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("failed"),
        *[number(paths).alias(name) for name, paths in TASK_TOTALS.items()],
    )


def telemetry_rollup(lines: DataFrame, run: str = "run_id", text: str = "value") -> DataFrame:
    """Eleven totals per run: tasks, failed tasks and the task metrics (missing counts as 0)."""
    tasks = task_rows(lines, run, text)
    return tasks.groupBy(run).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("failed").alias("failed_tasks"),
        *[F.sum(name).alias(name) for name in TASK_TOTALS],
    )


def resource_alignment(
    samples: DataFrame, source: str = "source", time: str = "timestamp",
    read: str = "disk_read_mb_s", write: str = "disk_write_mb_s",
) -> DataFrame:
    """Add minutes since the source's first sample and total disk traffic.

    The first sample is an aggregate joined back, so a source with very many samples is
    not sorted in one task.
    """
    first = samples.groupBy(source).agg(F.min(time).alias("__first"))
    joined = many_to_one(samples, first, source)
    return joined.withColumn("elapsed_min", (F.col(time) - F.col("__first")) / F.lit(60.0)).withColumn(
        "disk_mb_s", F.col(read) + F.col(write)
    ).drop("__first")


def resource_summary(aligned: DataFrame, source: str = "source", values: Sequence[str] = ("cpu_percent", "memory_percent", "disk_mb_s")) -> DataFrame:
    """Samples, duration and mean/max of every series per source."""
    columns = [F.count(F.lit(1)).alias("samples"), F.max("elapsed_min").alias("duration_min")]
    for v in values:
        columns += [F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max")]
    return aligned.groupBy(source).agg(*columns)
