"""Run records, event-log text and resource samples."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.indicators import decimal_from_text

RECORD_SCHEMA = T.StructType([
    T.StructField("scenario", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("spark_master", T.StringType()),
    T.StructField("input_format", T.StringType()),
    T.StructField("extract_seconds", T.DoubleType()),
    T.StructField("transform_seconds", T.DoubleType()),
    T.StructField("load_seconds", T.DoubleType()),
    T.StructField("total_seconds", T.DoubleType()),
    T.StructField("feature_rows", T.LongType()),
    T.StructField("raw_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("outputs", T.MapType(T.StringType(), T.StringType())),
])


def timed_run(
    spark: SparkSession,
    scenario: str,
    run_id: str,
    input_format: str,
    extract: Callable[[], Mapping[str, int]],
    transform: Callable[[], int],
    load: Callable[[], Mapping[str, str]],
) -> dict:
    """Run the three stages and return their record: seconds, counts and output paths."""
    marks = [time.perf_counter()]
    counts = extract()
    marks.append(time.perf_counter())
    rows = transform()
    marks.append(time.perf_counter())
    outputs = load()
    marks.append(time.perf_counter())
    seconds = [b - a for a, b in zip(marks, marks[1:])]
    return {
        "scenario": scenario,
        "run_id": run_id,
        "spark_master": spark.sparkContext.master,
        "input_format": input_format,
        "extract_seconds": seconds[0],
        "transform_seconds": seconds[1],
        "load_seconds": seconds[2],
        "total_seconds": sum(seconds),
        "feature_rows": int(rows),
        "raw_counts": {k: int(v) for k, v in counts.items()},
        "outputs": dict(outputs),
    }


def append_record(spark: SparkSession, record: Mapping, log: str) -> None:
    """Append one run record to a JSON run log."""
    spark.createDataFrame([dict(record)], RECORD_SCHEMA).coalesce(1).write.mode("append").json(log)


def upsert_records(spark: SparkSession, records: Sequence[Mapping], log: str) -> None:
    """Put run records into a log partitioned by run: a run's record replaces its earlier one, others stay.

    Only the partitions of these runs are rewritten, and only once the job has succeeded. So a write may be
    repeated or broken off at any point: the log holds each run's last complete record.
    """
    rows = spark.createDataFrame([{k: r.get(k) for k in RECORD_SCHEMA.names} for r in records], RECORD_SCHEMA)
    upsert_runs(rows, log)


def upsert_runs(rows: DataFrame, log: str, key: str = "run_id") -> None:
    """``rows`` into a Parquet table partitioned by ``key``, replacing the partitions they touch and no others."""
    writer = rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(key).parquet(log)


def read_log(spark: SparkSession, log: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """The run log that ``upsert_records`` keeps; one row per run."""
    return spark.read.schema(schema).parquet(log).select(*schema.names)


def read_records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Run records, one JSON document per file, pretty-printed or not, byte-order mark or not."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(paths)


def read_event_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(run_id, value): event-log lines, the run named by its file."""
    return spark.read.text(paths).select(F.col("_metadata.file_name").alias("run_id"), "value")


def read_resource_samples(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sample files with a header as numbers, tagged with ``source``; empty files add no rows."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)
    source = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return raw.select(source.alias("source"), *[decimal_from_text(c).alias(c) for c in columns])


def repair_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named text columns as numbers, decimal comma accepted, unparsable null."""
    return df.select(*[decimal_from_text(c).alias(c) if c in columns else F.col(c) for c in df.columns])
