"""The analysis of a complete run matrix as one plan: gates, telemetry, summary and paired contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.experiments import assert_gates, gate_report, paired_contrasts, run_summary, two_arm_comparison
from tidemark.operators.joins import assert_unique
from tidemark.operators.telemetry import telemetry_rollup
from tidemark.session import materialise
from tidemark.sources.runlog import repair_numbers

NUMBERS = ("feature_rows", "extract_seconds", "transform_seconds", "load_seconds", "total_seconds")


def measured_runs(manifest: DataFrame, expected_runs: int, input_format: str = "parquet") -> DataFrame:
    """Measured runs of a manifest, numbers repaired; raises if runs are missing, failed or of another input format.

    ``expected_runs`` counts all runs, warm-ups included. The format is asked of measured runs only.
    """
    text = [c for c, kind in manifest.dtypes if c in NUMBERS and kind == "string"]
    runs = materialise(repair_numbers(manifest, text))
    report = gate_report(runs, expected_runs, input_format=input_format).where("rule <> 'input_format'")
    measured = runs.where(F.col("phase") == "measured")
    formats = gate_report(measured, 0, input_format=input_format).where("rule = 'input_format'")
    assert_gates(report.unionByName(formats))
    return measured


def with_telemetry(runs: DataFrame, lines: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs with the totals of their event logs; each line is parsed once, and there is one row of totals a run already."""
    assert_unique(runs, [key], "runs")
    return runs.join(materialise(telemetry_rollup(lines, key)), key)


def validation_analysis(
    manifest: DataFrame,
    lines: DataFrame,
    expected_runs: int,
    control: str,
    arms: Sequence[str],
    single: tuple[str, str] | None = None,
    confidence: float = 0.95,
) -> dict[str, DataFrame]:
    """merged (measured runs with telemetry), summary per workload and scenario, contrasts with the
    control, Holm-adjusted within workloads, and for ``single`` (arm, control) one planned comparison."""
    merged = materialise(with_telemetry(measured_runs(manifest, expected_runs), lines))
    means = [m for m in ("extract_seconds", "transform_seconds", "load_seconds") if m in merged.columns]
    tables = {
        "merged": merged,
        "summary": run_summary(merged, means=means, telemetry=True),
        "contrasts": paired_contrasts(merged, list(arms), control, confidence=confidence),
    }
    if single is not None:
        tables["planned"] = two_arm_comparison(merged, *single, confidence=confidence)
    return tables
