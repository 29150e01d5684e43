"""Feature products on the synthetic clinic, the readers in front of them and the sinks behind."""

import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tests.clinic import write_clinic
from tests.helpers import formatted_plan, rows
from tidemark.operators.totals import entity_measures
from tidemark.plans.products import PRODUCTS, ProductSettings, feature_product
from tidemark.sources import runlog, sinks
from tidemark.sources.tables import (
    MissingSource,
    RAW_COLUMNS,
    convert_to_parquet,
    load_tables,
    read_csv_table,
    read_table,
    require_sources,
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clinic"))
    write_clinic(path)
    return path


@pytest.fixture(scope="module")
def tables(spark, folder):
    return load_tables(spark, folder)


def by_id(df):
    return {r["hadm_id"]: r for r in rows(df, "hadm_id")}


def test_compact(tables):
    df = feature_product("compact", tables)
    assert len(df.columns) == 34 and df.columns[:5] == ["hadm_id", "subject_id", "mortality_label", "age", "gender_male"]
    out = by_id(df)
    assert sorted(out) == [100, 101, 200, 300]
    a = out[100]
    # All seven readable in-range heart rates count, whatever their time; one has no time at all.
    assert a["heart_rate_count"] == 8.0 and a["heart_rate_mean"] == 95.0
    assert a["temperature_c_mean"] == pytest.approx(37.0) and a["spo2_count"] == 0.0 and a["spo2_mean"] is None
    assert (a["lab_value_mean"], a["lab_value_count"], a["lab_abnormal_count"]) == (3.0, 3.0, 1.0)
    assert a["age"] == 60.0 and a["gender_male"] == 1.0 and a["spo2_mean_missing"] == 1.0 and a["heart_rate_mean_missing"] == 0.0
    assert out[101]["mortality_label"] == 1 and out[101]["icu_stay_count"] == 2.0
    assert out[200]["age"] == 90.0 and out[200]["mortality_label"] == 0 and out[200]["icu_los_mean_missing"] == 1.0
    assert out[300]["age"] is None and out[300]["gender_male"] == 0.0 and out[300]["heart_rate_count"] is None


def test_wide(tables):
    df = feature_product("wide", tables)
    assert len(df.columns) == 115
    a = by_id(df)[100]
    assert a["heart_rate_min"] == 60.0 and a["heart_rate_max"] == 130.0 and a["heart_rate_median"] == 90.0
    assert a["heart_rate_mean_24h"] == 75.0  # 60, 70, 80, 90: the event before the stay counts
    assert a["heart_rate_mean_48h"] == 80.0  # up to and including 48 h
    assert a["heart_rate_trend"] == 60.0 and a["temperature_c_trend"] == 0.0 and a["spo2_trend"] is None
    bounded = by_id(feature_product("wide", tables, ProductSettings(means_from_reference=True)))[100]
    assert bounded["heart_rate_mean_24h"] == 80.0


def test_timeseries(tables):
    df = feature_product("timeseries", tables)
    assert len(df.columns) == 38 and df.columns[:2] == ["hadm_id", "window_idx"]
    out = {(r["hadm_id"], r["window_idx"]): r for r in rows(df, "hadm_id", "window_idx")}
    # Clipped to the stay: the event an hour before and the one a second after are gone.
    assert sorted(out) == [(100, 0), (100, 1), (100, 8), (100, 12), (101, 4)]
    assert out[(100, 0)]["heart_rate_mean"] == 75.0 and out[(100, 0)]["temperature_c_count"] == 1.0
    assert out[(101, 4)]["spo2_mean"] == 97.0 and out[(101, 4)]["heart_rate_count"] == 0.0  # the envelope spans the gap
    loose = feature_product("timeseries", tables, ProductSettings(clip_windows=False))
    assert {r["window_idx"] for r in loose.where("hadm_id = 100").collect()} == {0, 1, 8, 12}
    assert loose.where("hadm_id = 100").agg(F.sum("heart_rate_count")).first()[0] == 6.0


def test_early_window(tables):
    df = feature_product("early_window", tables)
    assert len(df.columns) == 69
    assert not [c for c in df.columns if "icu" in c or "ref" in c or "time" in c]
    out = by_id(df)
    assert sorted(out) == [100, 200]  # 101 reaches 48 h only across a gap
    a = out[100]
    assert a["heart_rate_count"] == 3.0 and a["heart_rate_max"] == 90.0 and a["heart_rate_median"] == 80.0
    assert (a["lab_value_count"], a["lab_abnormal_count"]) == (1.0, 1.0)
    assert out[200]["lab_value_count"] is None and out[200]["lab_value_count_missing"] == 1.0


def test_products_do_not_change_without_broadcast(tables, without_broadcast):
    for name in PRODUCTS:
        df = feature_product(name, tables)
        assert df.count() == {"compact": 4, "wide": 4, "timeseries": 5, "early_window": 2}[name]
        assert df.dropDuplicates(["hadm_id", "window_idx"] if name == "timeseries" else ["hadm_id"]).count() == df.count()


def test_medians_of_a_hot_entity_and_of_none(spark):
    data = [(1, "a", float(k * 7919 % 5003)) for k in range(5003)] + [(2, "a", 4.0), (2, "a", 8.0), (2, "b", None), (None, "b", 1.0), (3, "c", 5.0)]
    events = spark.createDataFrame(data, "hadm_id long, feature string, value double")
    found = entity_measures(events, "hadm_id", ["a", "b"], ["median", "count"], [F.count("*").alias("all_events")])
    assert found.columns == ["hadm_id", "a_median", "a_count", "b_median", "b_count", "all_events"]
    assert {tuple(r) for r in found.collect()} == {
        (1, 2501.0, 5003.0, None, 0.0, 5003), (2, 4.0, 2.0, None, 0.0, 3), (None, None, 0.0, 1.0, 1.0, 1), (3, None, 0.0, None, 0.0, 1),
    }
    assert {tuple(r) for r in entity_measures(events, "hadm_id", ["b"], ["median"]).collect()} == {(1, None), (2, None), (None, 1.0), (3, None)}


def test_unknown_names_raise(spark, tables, folder):
    with pytest.raises(ValueError):
        feature_product("compcat", tables)
    with pytest.raises(ValueError):
        read_table(spark, folder, "NOTES")
    with pytest.raises(ValueError):
        read_table(spark, folder, "PATIENTS", "orc")


def test_typed_projection_never_raises(tables):
    a = {r["hadm_id"]: r for r in rows(tables.admissions, "hadm_id")}
    assert a[300]["admittime"] is None and a[200]["hospital_expire_flag"] is None
    assert tables.events.count() == 13  # one row without admission is gone
    assert tables.events.where("valuenum is null").count() == 1
    assert dict(tables.stays.dtypes)["icu_los_days"] == "double"


def test_malformed_rows(spark, tmp_path):
    path = str(tmp_path / "t.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("A,B,C\n1,2\n1,2,3,4\n\"x\",,z\n")
    df = read_csv_table(spark, path, ["A", "B", "C"])
    assert df.columns == ["a", "b", "c"]
    assert rows(df, "a", "b") == [{"a": "1", "b": "2", "c": None}, {"a": "1", "b": "2", "c": "3"}, {"a": "x", "b": None, "c": "z"}] 


def test_missing_sources_are_all_named(spark, tmp_path):
    (tmp_path / "PATIENTS.csv.gz").write_bytes(gzip.compress(b"A\n"))
    with pytest.raises(MissingSource) as error:
        require_sources(spark, str(tmp_path))
    assert all(name in str(error.value) for name in RAW_COLUMNS if name != "PATIENTS") and "PATIENTS" not in str(error.value)


def test_conversion_and_pushdown(spark, folder, tables, tmp_path):
    raw, typed = str(tmp_path / "raw"), str(tmp_path / "typed")
    convert_to_parquet(spark, folder, raw, file_rows={"CHARTEVENTS": 4})
    convert_to_parquet(spark, folder, typed, as_typed=True)
    assert len([f for f in os.listdir(f"{raw}/CHARTEVENTS") if f.endswith(".parquet")]) == 4
    expected = rows(feature_product("compact", tables), "hadm_id")
    for path in (raw, typed):
        again = load_tables(spark, folder, "parquet", path)
        assert rows(feature_product("compact", again), "hadm_id") == expected
    text = formatted_plan(feature_product("compact", load_tables(spark, folder, "parquet", typed)))
    scan = next(block for block in text.split("\n\n") if "Scan parquet" in block and "itemid" in block)
    pushed = scan.split("PushedFilters: ")[1]
    assert "In(itemid, [" in pushed and "IsNotNull(valuenum)" in pushed
    assert "charttime" not in scan and "subject_id" not in scan  # pruned


def test_sinks_and_reading_back(spark, tables, tmp_path):
    df = feature_product("compact", tables)
    folder = str(tmp_path)
    paths = sinks.write_matrix(df, folder, "_early", files=1)
    assert sorted(paths) == ["csv_dir", "parquet"]
    assert sinks.read_matrix(spark, folder, "_early").count() == 4
    time.sleep(1.1)
    sinks.write_matrix(df.limit(2), folder, "_later", formats=["csv"])
    assert sinks.newest_matrix(spark, folder).endswith("feature_matrix_later_csv")
    assert sinks.read_any_matrix(spark, folder).count() == 2
    assert sinks.read_matrix(spark, folder, "_later", df.schema).schema["age"].dataType == df.schema["age"].dataType
    sinks.write_matrix(df, folder, formats=["csv"])
    assert sinks.read_any_matrix(spark, folder).count() == 4
    with pytest.raises(MissingSource):
        sinks.read_matrix(spark, folder, "_none")
    with pytest.raises(ValueError):
        sinks.write_matrix(df, folder, formats=["orc"])


def test_run_records(spark, tmp_path):
    record = runlog.timed_run(spark, "local", "r1", "parquet", lambda: {"events": 3}, lambda: 7, lambda: {"parquet": "p"})
    assert record["total_seconds"] == pytest.approx(record["extract_seconds"] + record["transform_seconds"] + record["load_seconds"])
    log = str(tmp_path / "log")
    runlog.append_record(spark, record, log)
    runlog.append_record(spark, {**record, "run_id": "r2"}, log)
    back = rows(runlog.read_records(spark, log, runlog.RECORD_SCHEMA), "run_id")
    assert [r["run_id"] for r in back] == ["r1", "r2"] and back[0]["raw_counts"] == {"events": 3}
    pretty = tmp_path / "pretty"
    pretty.mkdir()
    for i in range(3):
        (pretty / f"result_{i}.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"run_id": f"r{i}", "total_seconds": i + 0.5}, indent=4).encode())
    found = rows(runlog.read_records(spark, f"{pretty}/*.json"), "run_id")
    assert [(r["run_id"], r["total_seconds"]) for r in found] == [("r0", 0.5), ("r1", 1.5), ("r2", 2.5)]


def test_resource_samples_and_event_logs(spark, tmp_path):
    (tmp_path / "a_run.csv").write_text("timestamp,cpu_percent\n1.0,\n2.0,\"3,5\"\n")
    (tmp_path / "b_run.csv").write_text("timestamp,cpu_percent\n")
    (tmp_path / "c_run.csv").write_text("")
    out = rows(runlog.read_resource_samples(spark, f"{tmp_path}/*.csv", ["timestamp", "cpu_percent"]), "timestamp")
    assert out == [{"source": "a_run", "timestamp": 1.0, "cpu_percent": None}, {"source": "a_run", "timestamp": 2.0, "cpu_percent": 3.5}]
    (tmp_path / "app-1").write_text("{}\nx\n")
    assert rows(runlog.read_event_logs(spark, f"{tmp_path}/app-1"), "value") == [
        {"run_id": "app-1", "value": "x"}, {"run_id": "app-1", "value": "{}"}]
    text = spark.createDataFrame([("12,5",), (">200",), ("",), (None,), ("7.25",)], "v string")
    assert [r["v"] for r in runlog.repair_numbers(text, ["v"]).collect()] == [12.5, None, None, None, 7.25]
