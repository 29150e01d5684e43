"""From raw tables to a written product and its record, and the log that keeps the records."""

import pytest
from pyspark.sql import functions as F, types as T

from tests.clinic import write_clinic
from tests.helpers import plan, rows
from tidemark.plans.etl import record_rows, run_product
from tidemark.sources.runlog import RECORD_SCHEMA, read_log, upsert_records, upsert_runs
from tidemark.sources.sinks import read_matrix
from tidemark.sources.tables import convert_to_buckets, load_buckets, load_tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clinic"))
    write_clinic(path)
    return path


def jobs_of(spark, group, work):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


@pytest.mark.parametrize("product", ["compact", "wide", "timeseries", "early_window"])
def test_one_call_writes_product_and_record(spark, folder, tmp_path, product):
    log = str(tmp_path / "log")
    record = run_product(spark, folder, str(tmp_path), product, "local", f"run-{product}", log, formats=["parquet"])
    tables = load_tables(spark, folder)
    assert record["raw_counts"] == {n: getattr(tables, n).count() for n in ("admissions", "patients", "stays", "events", "labs")}
    suffix = {"compact": ""}.get(product, f"_{product}")
    assert record["feature_rows"] == read_matrix(spark, str(tmp_path), suffix).count() > 0
    kept = read_log(spark, log).collect()
    assert len(kept) == 1 and kept[0]["raw_counts"] == record["raw_counts"] and kept[0]["outputs"] == record["outputs"]
    assert record_rows([record])[-1] == (f"run-{product}", "product", record["feature_rows"])
    if product == "timeseries":
        audit = record["clip_audit"]
        assert audit["candidate_rows"] == audit["kept_rows"] + audit["clipped_rows"] and audit["clipped_rows"] > 0


def test_counts_take_no_jobs_of_their_own(spark, folder, tmp_path):
    from tidemark.plans.products import feature_product
    from tidemark.sources.sinks import write_matrix

    _, plain = jobs_of(spark, "plain", lambda: write_matrix(
        feature_product("compact", load_tables(spark, folder)), str(tmp_path / "a"), formats=["parquet"]))
    record, counted = jobs_of(spark, "counted", lambda: run_product(
        spark, folder, str(tmp_path / "b"), "compact", "s", "r", formats=["parquet"]))
    assert counted <= plain and record["raw_counts"]["events"] == 13


def record(run, seconds):
    return {"scenario": "s", "run_id": run, "total_seconds": seconds, "raw_counts": {"events": 1}, "outputs": {}}


def test_log_may_be_written_twice_or_broken_off(spark, tmp_path):
    log = str(tmp_path / "log")
    upsert_records(spark, [record("a", 1.0), record("b", 2.0)], log)
    upsert_records(spark, [record("a", 1.0), record("b", 2.0)], log)
    seen = lambda: {r["run_id"]: r["total_seconds"] for r in read_log(spark, log).collect()}
    assert read_log(spark, log).count() == 2 and seen() == {"a": 1.0, "b": 2.0}

    breaks = F.udf(lambda n: 1 // 0, T.DoubleType())
    rows = spark.createDataFrame([record("b", 9.0), record("c", 9.0)], RECORD_SCHEMA)
    with pytest.raises(Exception, match="division"):
        upsert_runs(rows.withColumn("total_seconds", F.when(F.col("run_id") == "c", breaks("run_id")).otherwise(9.0)), log)
    assert seen() == {"a": 1.0, "b": 2.0}
    upsert_records(spark, [record("b", 9.0), record("007", 3.0)], log)
    assert seen() == {"a": 1.0, "b": 9.0, "007": 3.0}


def test_bucketed_tables_are_joined_and_grouped_without_an_exchange(spark, folder, tmp_path, without_broadcast):
    from tidemark.operators.align import on_entity_clock
    from tidemark.operators.codes import normalise_events
    from tidemark.operators.reference import envelope
    from tidemark.plans.products import ProductSettings, feature_product

    convert_to_buckets(spark, folder, str(tmp_path), 4, prefix="clinic_")
    stored, plain = load_buckets(spark, "clinic_"), load_tables(spark, folder)
    book = ProductSettings().book
    events = normalise_events(stored.events.select("hadm_id", "itemid", "charttime", "valuenum"), book)
    by_entity = on_entity_clock(events, envelope(stored.stays), "hadm_id", colocated=True).groupBy("hadm_id").agg(F.avg("value").alias("v"))
    text = plan(by_entity)
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" in text
    assert "In(itemid" in text or "itemid IN" in text or "In(" in text
    assert by_entity.count() == 2
    for product in ("compact", "timeseries"):
        keys = ["hadm_id"] + ["window_idx"] * (product == "timeseries")
        assert rows(feature_product(product, stored), *keys) == rows(feature_product(product, plain), *keys)
