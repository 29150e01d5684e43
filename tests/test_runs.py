"""Run analytics, telemetry and reports."""

import json
import math
import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.functions.tdist import critical_value, log_two_sided_p, two_sided_p
from tidemark.operators import experiments as ex
from tidemark.operators import reports
from tidemark.operators.telemetry import resource_alignment, resource_summary, telemetry_rollup

# Published paired t statistics (11 degrees of freedom) with raw and Holm-adjusted p values.
PUBLISHED = {
    "compact": [
        ("local2 - local8", 18.019483396021155, 1.6308365759354237e-09, 6.523346303741695e-09),
        ("local4 - local8", 7.079030845347153, 2.0479923764330673e-05, 2.0479923764330673e-05),
        ("standalone1 - local8", 9.153355637515059, 1.7762196471770911e-06, 3.5524392943541823e-06),
        ("standalone2 - local8", 10.770570134746663, 3.5041301106755674e-07, 1.0512390332026702e-06),
    ],
    "timeseries": [
        ("local2 - local8", 17.370370631603954, 2.410907555676438e-09, 7.232722667029314e-09),
        ("local4 - local8", 6.390899640018753, 5.144890311558678e-05, 5.144890311558678e-05),
        ("standalone1 - local8", 25.065358472495745, 4.6877059858634407e-11, 1.8750823943453763e-10),
        ("standalone2 - local8", 11.334234684450498, 2.0869319760938917e-07, 4.1738639521877835e-07),
    ],
}


def test_published_p_values_and_holm(spark):
    data = [(w, c, t) for w, cases in PUBLISHED.items() for c, t, _, _ in cases]
    df = spark.createDataFrame(data, "workload string, comparison string, t double")
    tests = df.withColumn("p_raw", two_sided_p(F.col("t"), F.lit(11)))
    out = {(r["workload"], r["comparison"]): r for r in ex.holm_adjust(tests, ["workload"], tie=["comparison"]).collect()}
    for w, cases in PUBLISHED.items():
        for c, _, raw, holm in cases:
            assert out[(w, c)]["p_raw"] == pytest.approx(raw, rel=1e-11)
            assert out[(w, c)]["p_holm"] == pytest.approx(holm, rel=1e-11)


def test_t_distribution_reference_points(spark):
    cases = [(1, 12.706204736), (2, 4.30265273), (11, 2.20098516), (30, 2.042272456), (119, 1.980099876)]
    df = spark.createDataFrame(cases, "v int, t double")
    for r in df.select("v", "t", critical_value(F.col("v")).alias("c"), two_sided_p(F.col("t"), F.col("v")).alias("p")).collect():
        assert r["c"] == pytest.approx(r["t"], rel=1e-8) and r["p"] == pytest.approx(0.05, rel=1e-7)
    edge = spark.createDataFrame([(0.0, 5), (1.0, 0), (None, 5), (-1.0, 1)], "t double, v int")
    found = [r[0] for r in edge.select(two_sided_p(F.col("t"), F.col("v"))).collect()]
    assert found[0] == 1.0 and found[1] is None and found[2] is None and found[3] == pytest.approx(0.5)


def exact_log_p(t: float, df: int) -> float:
    """For an even df the distribution is a finite sum, taken here with 420 digits."""
    with localcontext() as context:
        context.prec = 420
        t = Decimal(t)
        shrink, term, total = 1 / (1 + t * t / df), Decimal(1), Decimal(0)
        for k in range(df // 2):
            total += term
            term = term * shrink * (2 * k + 1) / (2 * k + 2)
        return float((1 - t / (df + t * t).sqrt() * total).ln())


def test_t_distribution_large_statistics_and_degrees(spark):
    cases = [(df, t) for df in (2, 120, 400, 10_000) for t in (0.1, 2.0, 8.0, 15.0, 40.0)]
    frame = spark.createDataFrame(cases, "v long, t double")
    for r in frame.select("v", "t", log_two_sided_p(F.col("t"), F.col("v")).alias("p")).collect():
        assert r["p"] == pytest.approx(exact_log_p(r["t"], r["v"]), rel=1e-11)
    # One degree is an arc tangent; with very many the normal distribution's next term is known.
    cauchy = spark.createDataFrame([(t,) for t in (0.1, 2.0, 40.0, 1e200)], "t double")
    for r in cauchy.select("t", log_two_sided_p(F.col("t"), F.lit(1)).alias("p")).collect():
        assert r["p"] == pytest.approx(math.log(2 / math.pi * math.atan(1 / r["t"])), rel=1e-12)
    for df in (10**6, 10**8):
        near = spark.range(1).select(two_sided_p(F.lit(2.0), F.lit(df))).first()[0]
        normal = math.exp(-2) / math.sqrt(2 * math.pi)
        assert near == pytest.approx(math.erfc(math.sqrt(2)) + 2 * normal * (8 + 2) / (4 * df), rel=1e-10)
    found = spark.range(1).select(
        critical_value(F.lit(1_500_000)), critical_value(F.lit(1), 0.999999), two_sided_p(F.lit(math.inf), F.lit(7))
    ).first()
    assert found[0] == pytest.approx(1.9599655660, rel=1e-9)
    assert found[1] == pytest.approx(1 / math.tan(math.pi / 2 * 1e-6), rel=1e-8) and found[2] == 0.0
    with pytest.raises(ValueError):
        critical_value(F.lit(3), 1.0)


def runs(spark):
    rng = random.Random(1)
    data = [
        ("compact", s, b, base + rng.gauss(0, 5), "ok", "parquet", 10)
        for b in range(1, 13) for s, base in (("local8", 200.0), ("local2", 280.0), ("local4", 200.0))
        if (s, b) != ("local4", 3)
    ]
    return data, spark.createDataFrame(
        data, "workload string, scenario string, block int, total_seconds double, status string, input_format string, feature_rows long"
    )


def test_paired_contrasts(spark):
    data, df = runs(spark)
    out = {r["comparison"]: r for r in ex.paired_contrasts(df, ["local2", "local4"], "local8").collect()}
    cell = {(s, b): t for _, s, b, t, *_ in data}
    for arm, n in (("local2", 12), ("local4", 11)):
        blocks = [b for b in range(1, 13) if (arm, b) in cell]
        gaps = [cell[(arm, b)] - cell[("local8", b)] for b in blocks]
        mean = sum(gaps) / n
        sd = math.sqrt(sum((g - mean) ** 2 for g in gaps) / (n - 1))
        r = out[f"{arm} - local8"]
        assert r["n_blocks"] == n and r["mean_difference"] == pytest.approx(mean)
        assert r["paired_t"] == pytest.approx(mean / (sd / math.sqrt(n)))
        crit = {12: 2.2009851600916, 11: 2.2281388519649}[n]
        assert r["difference_ci_high"] == pytest.approx(mean + crit * sd / math.sqrt(n))
        logs = [math.log(cell[(arm, b)] / cell[("local8", b)]) for b in blocks]
        assert r["geometric_ratio"] == pytest.approx(math.exp(sum(logs) / n))
        assert r["ratio_ci_low"] < r["geometric_ratio"] < r["ratio_ci_high"]
    two = ex.two_arm_comparison(df, "local2", "local8").first()
    assert two["p_raw"] == pytest.approx(out["local2 - local8"]["p_raw"]) and two["arm_mean"] > two["control_mean"]


def test_equal_arms_have_no_t(spark):
    df = spark.createDataFrame(
        [("w", s, b, 5.0) for s in ("a", "b") for b in range(3)], "workload string, scenario string, block int, total_seconds double"
    )
    r = ex.two_arm_comparison(df, "a", "b").first()
    assert r["mean_difference"] == 0.0 and r["paired_t"] is None and r["p_raw"] is None


def test_schedule_is_complete_seeded_and_resumable(spark):
    levels = [spark.createDataFrame([(x,) for x in xs], f"{n} {t}") for n, t, xs in (
        ("workload", "string", ["compact", "timeseries"]), ("scenario", "string", ["a", "b", "c"]), ("block", "int", [0, 1, 2]))]
    cells = ex.run_cells(*levels)
    schedule = ex.block_schedule(cells, 9)
    out = rows(schedule, "global_order")
    assert [r["global_order"] for r in out] == list(range(1, 19))
    assert [r["block"] for r in out] == sorted(r["block"] for r in out)
    assert {r["phase"] for r in out if r["block"] == 0} == {"warmup"} and out[-1]["phase"] == "measured"
    for b in (0, 1, 2):
        assert len({(r["workload"], r["scenario"]) for r in out if r["block"] == b}) == 6
    assert rows(ex.block_schedule(cells.repartition(3), 9), "global_order") == out
    order = lambda seed: [(r["workload"], r["scenario"]) for r in rows(ex.block_schedule(cells, seed), "global_order")]
    assert order(9) != order(10)
    done = spark.createDataFrame([("compact", "a", 0, "ok"), ("compact", "b", 0, "failed")], "workload string, scenario string, block int, status string")
    assert ex.pending_cells(schedule, done, ["workload", "scenario", "block"]).count() == 17


def test_gates(spark):
    _, df = runs(spark)
    wanted = spark.createDataFrame([("compact", 10)], "workload string, feature_rows long")
    ex.assert_gates(ex.gate_report(df, 35, wanted))
    bad = df.withColumn("status", F.when(F.col("block") == 2, F.lit("failed")).otherwise(F.col("status")))
    bad = bad.withColumn("input_format", F.when(F.col("block") == 1, F.lit(None)).otherwise(F.col("input_format")))
    report = {r["rule"]: r["offending"] for r in ex.gate_report(bad, 36, spark.createDataFrame([("compact", 11)], wanted.schema)).collect()}
    assert report == {"run_count": 1, "all_ok": 3, "input_format": 3, "feature_rows": 35}
    with pytest.raises(ex.GateFailed):
        ex.assert_gates(ex.gate_report(bad, 36))


def test_upsert(spark):
    old = spark.createDataFrame([("r1", 1, "failed"), ("r1", 2, "failed"), ("r2", 5, "ok")], "run_id string, at int, status string")
    new = spark.createDataFrame([("r1", 0, "ok"), ("r3", 1, "ok")], old.schema)
    out = {r["run_id"]: (r["at"], r["status"]) for r in ex.upsert_latest(old, new, "run_id", ["at"]).collect()}
    assert out == {"r1": (0, "ok"), "r2": (5, "ok"), "r3": (1, "ok")}


def test_run_summary_with_telemetry(spark):
    data = [("w", "s", t, 1.0, 2e9, 500, 2 * 1024 ** 3, 0, 1024 ** 3, i) for i, t in enumerate([1.0, 2.0, 4.0, 9.0])]
    df = spark.createDataFrame(
        data, "workload string, scenario string, total_seconds double, extract_seconds double, executor_cpu_ns double, "
        "jvm_gc_ms long, shuffle_read_bytes long, shuffle_write_bytes long, disk_spill_bytes long, failed_tasks int"
    )
    r = ex.run_summary(df, means=["extract_seconds"], telemetry=True).first()
    assert (r["n"], r["total_mean"], r["total_median"], r["extract_mean"]) == (4, 4.0, 3.0, 1.0)
    assert (r["executor_cpu_s"], r["gc_s"], r["shuffle_read_gb"], r["spill_gb"], r["failed_tasks"]) == (2.0, 0.5, 2.0, 1.0, 6)


def test_speedup_against_a_named_baseline(spark):
    df = spark.createDataFrame([("one", 100.0, 2), ("two", 50.0, 4), ("three", 80.0, 8)], "scenario string, total_seconds_mean double, cores int")
    out = {r["scenario"]: (r["speedup"], r["efficiency"]) for r in ex.speedup_efficiency(df, "one").collect()}
    assert out == {"one": (1.0, 1.0), "two": (2.0, 1.0), "three": (1.25, 0.313)}


def test_telemetry_skips_broken_and_foreign_lines(spark):
    end = {"Event": "SparkListenerTaskEnd", "Task End Reason": {"Reason": "Success"}, "Stage ID": 3,
           "Task Metrics": {"Executor Run Time": 5, "Executor CPU Time": 7, "JVM GC Time": 1, "Memory Bytes Spilled": 2,
                            "Disk Bytes Spilled": 3, "Shuffle Read Metrics": {"Remote Bytes Read": 10, "Local Bytes Read": 20},
                            "Shuffle Write Metrics": {"Shuffle Bytes Written": 30}, "Input Metrics": {"Bytes Read": 40},
                            "Output Metrics": {"Bytes Written": 50}}}
    bare = {"Event": "SparkListenerTaskEnd", "Task End Reason": {"Reason": "ExceptionFailure"}}
    start = {"Event": "SparkListenerTaskStart", "note": "SparkListenerTaskEnd"}
    text = json.dumps(end)
    lines = [text, text, json.dumps(bare), json.dumps(start), text[:80], text[:-1], "", "not json SparkListenerTaskEnd"]
    df = spark.createDataFrame([("r", line) for line in lines] + [("empty", text[:30])], "run_id string, value string")
    out = telemetry_rollup(df).collect()
    assert len(out) == 1
    assert out[0].asDict() == {
        "run_id": "r", "tasks": 3, "failed_tasks": 1, "executor_run_ms": 10, "executor_cpu_ns": 14, "jvm_gc_ms": 2,
        "memory_spill_bytes": 4, "disk_spill_bytes": 6, "shuffle_read_bytes": 60, "shuffle_write_bytes": 60,
        "input_bytes": 80, "output_bytes": 100,
    }


def test_telemetry_counts_every_well_formed_event(spark):
    def line(metrics):
        return json.dumps({"Event": "SparkListenerTaskEnd", "Task End Reason": {"Reason": "Success"}, "Task Metrics": metrics})

    lines = [
        line({"Executor Run Time": 5.5, "JVM GC Time": 4}), line(None), line({"Executor Run Time": "soon", "JVM GC Time": 2}),
        line({"Executor CPU Time": 2**53 - 1}), line({"Executor CPU Time": 2**53 - 1}), line({"Shuffle Read Metrics": 3, "JVM GC Time": 1}),
        line({"Executor Run Time": 5.5})[:-1],
    ]
    out = telemetry_rollup(spark.createDataFrame([("r", x) for x in lines], "run_id string, value string")).first()
    assert (out["tasks"], out["failed_tasks"]) == (6, 0)
    assert (out["executor_run_ms"], out["jvm_gc_ms"], out["executor_cpu_ns"]) == (5, 7, 2**54 - 2)


def test_resource_alignment(spark):
    data = [("a", 100.0, 1.0, 2.0, 3.0, 4.0), ("a", 160.0, 3.0, 2.0, 3.0, None), ("b", 500.0, 5.0, 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "source string, timestamp double, cpu_percent double, memory_percent double, disk_read_mb_s double, disk_write_mb_s double")
    out = rows(resource_alignment(df), "source", "timestamp")
    assert [r["elapsed_min"] for r in out] == [0.0, 1.0, 0.0] and [r["disk_mb_s"] for r in out] == [7.0, None, 0.0]
    assert rows(resource_summary(resource_alignment(df)), "source")[0]["cpu_percent_mean"] == 2.0


def test_reports(spark):
    df = spark.createDataFrame([(1, 0, 1.0, None), (1, 1, None, None), (2, 0, 2.0, None), (3, None, 4.0, 1.0)], "g int, y int, a double, b double")
    assert {r["y"]: r["proportion"] for r in reports.class_balance(df, "y").collect()} == {0: pytest.approx(2 / 3), 1: pytest.approx(1 / 3)}
    assert [(r["feature"], r["missing_fraction"]) for r in reports.missing_fraction(df, ["a", "b"]).collect()] == [("b", 0.75), ("a", 0.25)]
    flow = reports.cohort_flow([("all", df), ("labelled", df.where("y is not null"))], "g").collect()
    assert [tuple(r) for r in flow] == [("all", 4, 3), ("labelled", 3, 2)]
    summary = rows(reports.group_summary(df, ["g"], ["a"]), "g")
    assert summary[1] == {"g": 2, "a_mean": 2.0, "a_std": None, "a_min": 2.0, "a_max": 2.0}
    text = reports.mean_std_text(spark.createDataFrame([("s", 1.005, 0.25)], "k string, v_mean double, v_std double"), ["k"], ["v"])
    assert text.first()["v_mean_std"] in ("1.00 ± 0.25", "1.01 ± 0.25")
    assert [r["g"] for r in reports.top_rows(df, "a", "g", 2).collect()] == [3, 2]
    assert {r["table_name"]: r["n_rows"] for r in reports.source_audit({"x": df, "y": df.limit(1)}).collect()} == {"x": 4, "y": 1}
