"""The leak-free evaluation of one feature product as one plan, from cohort flow to importances."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark import presets
from tidemark.operators.prep import model_frame
from tidemark.operators.reports import class_balance, cohort_flow, missing_fraction, top_rows
from tidemark.operators.splits import fold_diagnostics, repeated_group_holdouts, split_diagnostics, with_group_folds
from tidemark.plans import validation as v
from tidemark.session import materialise

FOREST = "Random Forest"


def cohort_report(matrix: DataFrame, settings: v.ValidationSettings, repeats: int, folds: int) -> dict[str, DataFrame]:
    """What can be said before any model is fitted: flow, balance, missingness, and the splits that models would get."""
    labelled, features = model_frame(matrix, settings.label, [*settings.ids, settings.group])
    seeds = [settings.seed + r for r in range(repeats)]
    held_out = repeated_group_holdouts(labelled, settings.group, settings.label, seeds, settings.test_size)
    dealt = materialise(with_group_folds(labelled, settings.group, settings.label, settings.seed, folds))
    return {
        "cohort_flow": cohort_flow([("all_rows", matrix), ("labelled_rows", labelled)], settings.group),
        "class_balance": class_balance(labelled, settings.label),
        "missingness": missing_fraction(labelled, features),
        "holdout_diagnostics": split_diagnostics(held_out, settings.group, settings.label, by=["seed"]),
        "cv_diagnostics": fold_diagnostics(dealt, settings.group, settings.label),
    }


def leakfree_report(
    matrix: DataFrame, settings: v.ValidationSettings, repeats: int = presets.REPEATS, folds: int = presets.FOLDS, top: int | None = None
) -> dict[str, DataFrame]:
    """All tables of the evaluation, by name.

    On top of ``cohort_report``: metrics per repeat and per fold with their summaries, from models that see
    training rows only and are recalibrated on folds of them, and importances of the forest (or else of the
    first learner that has any) fitted to all labelled rows.
    """
    labelled, _ = model_frame(matrix, settings.label, [*settings.ids, settings.group])
    frame = materialise(labelled)
    tables = cohort_report(matrix, settings, repeats, folds)
    for name, unit, scores in (
        ("holdout", "repeat", v.grouped_holdout_scores(frame, settings, repeats)),
        ("cv", "fold", v.grouped_cv_scores(frame, replace(settings, folds=folds))),
    ):
        metrics = materialise(v.metric_table(scores, unit, settings.threshold))
        tables[f"{name}_metrics"] = metrics
        tables[f"{name}_summary"] = v.metric_summary(metrics)
    names = [n for n in (FOREST, *settings.learners) if n in settings.learners]
    for name in names:
        fitted = v.fit_pipeline(frame, settings.learners[name], settings, settings.seed).model
        if name != "Logistic Regression":
            ranked = fitted.importances(frame.sparkSession)
            tables["importance"] = ranked if top is None else top_rows(ranked, "importance", "feature", top)
            break
    return tables


def as_long(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(section, item, measure, value) of several tables: their first column names the item, numbers are measures."""
    parts = []
    for section, df in tables.items():
        item, *rest = df.columns
        cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in rest])
        parts.append(df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.inline(cells)))
    return reduce(DataFrame.unionByName, parts)


def write_report(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table as one CSV folder with a header; returns their paths."""
    paths = {name: f"{folder}/{name}_csv" for name in tables}
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(paths[name])
    return paths
