"""The evaluation report and the run analysis as whole plans."""

import functools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.boosting import fit_boosted
from tidemark.operators.experiments import GateFailed
from tidemark.operators.joins import KeyNotUnique
from tidemark.operators.models import fit_logistic
from tidemark.plans import validation as v
from tidemark.plans.analysis import validation_analysis, with_telemetry
from tidemark.plans.report import as_long, leakfree_report, write_report
from tidemark.session import shared_folder


def test_leakfree_report(spark, tmp_path):
    draw = random.Random(4)
    data = []
    for i in range(240):
        x = draw.gauss(0, 1)
        label = None if i % 40 == 0 else int(x + draw.gauss(0, 0.5) > 0.5)
        data.append((i, i // 2, label, x if i % 9 else None, draw.random()))
    matrix = spark.createDataFrame(data, "hadm_id long, subject_id long, mortality_label int, x double, noise double")
    learners = {"Logistic Regression": fit_logistic, "Gradient Boosting": functools.partial(fit_boosted, rounds=2, leaves=4)}
    settings = v.ValidationSettings(["x", "noise"], learners=learners, inner_folds=2)
    tables = leakfree_report(matrix, settings, repeats=1, folds=2)
    flow = {r["stage"]: (r["n_rows"], r["n_patients"]) for r in tables["cohort_flow"].collect()}
    assert flow == {"all_rows": (240, 120), "labelled_rows": (234, 120)}
    assert {r["feature"] for r in tables["missingness"].where("missing_fraction > 0").collect()} == {"x"}
    assert tables["holdout_diagnostics"].count() == 1 and tables["cv_diagnostics"].count() == 2
    assert tables["holdout_metrics"].count() == 2 and tables["cv_metrics"].count() == 4
    summary = {r["model"]: r for r in tables["cv_summary"].collect()}
    assert set(summary) == set(learners) and all(r["auroc_mean"] > 0.8 for r in summary.values())
    assert tables["importance"].first()["feature"] == "x"
    paths = write_report({k: tables[k] for k in ("cohort_flow", "cv_diagnostics")}, str(tmp_path))
    assert spark.read.option("header", True).csv(paths["cv_diagnostics"]).count() == 2
    assert as_long({"cohort_flow": tables["cohort_flow"]}).count() == 4


def end(run_ms, failed):
    return json.dumps({
        "Event": "SparkListenerTaskEnd", "Task End Reason": {"Reason": "ExceptionFailure" if failed else "Success"},
        "Task Metrics": {"Executor Run Time": run_ms, "Executor CPU Time": 2_000_000_000, "JVM GC Time": 500},
    })


def manifest(spark, broken=None):
    data = []
    for workload in ("compact", "wide"):
        for scenario, base in (("local", 8.0), ("cluster", 4.0)):
            for block in range(5):
                run = f"{workload}-{scenario}-{block}"
                status = "failed" if run == broken else "ok"
                seconds = f"{base + block + len(workload) / 10:.2f}".replace(".", ",")
                data.append((run, workload, scenario, block, "warmup" if block == 0 else "measured", status, "parquet", "10", "1,0", "2,0", "1,5", seconds))
    names = "run_id workload scenario block phase status input_format feature_rows extract_seconds transform_seconds load_seconds total_seconds"
    return spark.createDataFrame(data, " string, ".join(names.split()) + " string").withColumn("block", F.col("block").cast("int"))


def test_run_analysis(spark):
    runs = manifest(spark)
    lines = spark.createDataFrame(
        [(r["run_id"], end(100, k == 0)) for r in runs.select("run_id").collect() for k in range(3)] + [("other", end(1, False))],
        "run_id string, value string",
    )
    tables = validation_analysis(runs, lines, 20, "local", ["cluster"], single=("cluster", "local"))
    assert tables["merged"].count() == 16 and tables["merged"].first()["tasks"] == 3
    summary = {(r["workload"], r["scenario"]): r for r in tables["summary"].collect()}
    one = summary[("wide", "local")]
    assert (one["n"], one["total_median"], one["failed_tasks"], one["executor_cpu_s"], one["gc_s"]) == (4, pytest.approx(10.9), 4, 6.0, 1.5)
    contrast = {r["workload"]: r for r in tables["contrasts"].collect()}
    assert contrast["wide"]["mean_difference"] == pytest.approx(-4.0) and contrast["wide"]["n_blocks"] == 4
    assert tables["planned"].count() == 2
    with pytest.raises(GateFailed, match="run_count"):
        validation_analysis(runs, lines, 21, "local", ["cluster"])
    with pytest.raises(GateFailed, match="all_ok"):
        validation_analysis(manifest(spark, "wide-local-3"), lines, 20, "local", ["cluster"])
    with pytest.raises(GateFailed, match="input_format"):
        csv = runs.withColumn("input_format", F.when(F.col("block") == 2, "csv").otherwise("parquet"))
        validation_analysis(csv, lines, 20, "local", ["cluster"])
    with pytest.raises(KeyNotUnique):
        with_telemetry(runs.unionByName(runs), lines)


def test_a_local_session_may_lack_a_shared_folder(spark):
    assert shared_folder(spark)
