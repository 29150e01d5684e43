"""One call from source tables to a written feature product and its run record."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tidemark.plans.products import CohortTables, ProductSettings, feature_product
from tidemark.sources.runlog import upsert_records
from tidemark.sources.sinks import write_matrix
from tidemark.sources.tables import load_tables

TABLES = ("admissions", "patients", "stays", "events", "labs")
SUFFIX = {"compact": "", "wide": "_wide", "timeseries": "_timeseries", "early_window": "_early_window"}


class Observed:
    """Counts that come from the pass over a table that some later job makes anyway."""

    def __init__(self):
        self._asked: dict[str, Observation] = {}

    def __call__(self, name: str, df: DataFrame, *metrics: Column) -> DataFrame:
        """``df``; its first complete pass also computes ``metrics`` (by default its number of rows)."""
        self._asked[name] = Observation(name)
        return df.observe(self._asked[name], *(metrics or [F.count(F.lit(1)).alias("n_rows")]))

    def __getitem__(self, name: str) -> dict:
        return dict(self._asked[name].get)

    def __contains__(self, name: str) -> bool:
        return name in self._asked


def run_product(
    spark: SparkSession,
    source: str,
    target: str,
    product: str,
    scenario: str,
    run_id: str,
    log: str | None = None,
    input_format: str = "csv",
    parquet_dir: str | None = None,
    settings: ProductSettings = ProductSettings(),
    formats: Sequence[str] = ("parquet", "csv"),
    files: int | None = None,
    tables: CohortTables | None = None,
) -> dict:
    """Read, build and write one product; returns its run record, which also goes to ``log``.

    The counts of the tables, of clipped events and of the product's rows are taken by the job that writes the
    product: no table is scanned to be counted. Counts are of rows that reach the plan: events and lab results
    without an admission are not among them. As everything runs in the writing job, ``load_seconds`` holds nearly all
    of the time; ``transform_seconds`` is the time to plan, with the passes that exact medians need. ``tables`` stand in for the
    source files. A run repeated under its ``run_id`` replaces its product and its record.
    """
    observed = Observed()
    marks = [time.perf_counter()]
    read = tables if tables is not None else load_tables(spark, source, input_format, parquet_dir)
    marks.append(time.perf_counter())
    matrix = observed("product", feature_product(product, read, settings, observed))
    marks.append(time.perf_counter())
    outputs = write_matrix(matrix, target, SUFFIX[product], formats, files)
    marks.append(time.perf_counter())
    seconds = [b - a for a, b in zip(marks, marks[1:])]
    record = {
        "scenario": scenario,
        "run_id": run_id,
        "spark_master": spark.sparkContext.master,
        "input_format": input_format,
        "extract_seconds": seconds[0],
        "transform_seconds": seconds[1],
        "load_seconds": seconds[2],
        "total_seconds": sum(seconds),
        "feature_rows": int(observed["product"]["n_rows"]),
        "raw_counts": {name: int(observed[name]["n_rows"]) for name in TABLES},
        "outputs": outputs,
    }
    if log is not None:
        upsert_records(spark, [record], log)
    return record | ({"clip_audit": observed["clip"]} if "clip" in observed else {})


def record_rows(records: Sequence[Mapping]) -> list[tuple[str, str, int]]:
    """(run_id, what was counted, rows) of run records."""
    return [(r["run_id"], name, n) for r in records for name, n in [*r["raw_counts"].items(), ("product", r["feature_rows"])]]
