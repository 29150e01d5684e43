"""Leak-safe model validation: grouped or stratified splits, train-only fitting, recalibration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark import presets
from tidemark.operators.evaluate import METRICS, all_metrics
from tidemark.operators.boosting import BoostedTrees
from tidemark.operators.models import LEARNERS, FittedModel, Learner, fit_sigmoid, recalibrated
from tidemark.operators.prep import Preprocessor, mutual_information
from tidemark.operators.reports import group_summary
from tidemark.operators.splits import (
    assert_groups_disjoint,
    group_holdout,
    stratified_folds,
    stratified_holdout,
    with_group_folds,
)
from tidemark.session import materialise, spread


@dataclass(frozen=True)
class ValidationSettings:
    features: Sequence[str]
    label: str = "mortality_label"
    group: str = "subject_id"
    ids: Sequence[str] = ("hadm_id",)
    learners: Mapping[str, Learner] = field(default_factory=lambda: dict(LEARNERS))
    clip: tuple[float, float] = presets.CLIP_QUANTILES
    top_features: int | None = None
    seed: int = presets.BASE_SEED
    test_size: float = presets.TEST_SIZE
    folds: int = presets.FOLDS
    inner_folds: int = 5
    threshold: float = presets.THRESHOLD


@dataclass(frozen=True)
class FittedPipeline:
    """Preprocessing and model learnt from the same training rows."""

    prep: Preprocessor
    model: FittedModel | BoostedTrees

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return self.model.score(self.prep.transform(df, keep), keep)


def fit_pipeline(train: DataFrame, learner: Learner, settings: ValidationSettings, seed: int) -> FittedPipeline:
    """Impute, clip, scale, optionally select, and fit; only ``train`` is read."""
    prep = Preprocessor.fit(train, settings.features, settings.clip)
    ready = prep.transform(train, [settings.label])
    chosen = prep.features
    if settings.top_features is not None:
        best = mutual_information(ready, chosen, settings.label, top=settings.top_features)
        kept = {row["feature"] for row in best.collect()}
        chosen = [f for f in chosen if f in kept]
    return FittedPipeline(prep, learner(ready, chosen, settings.label, seed))


def plain_scores(split: DataFrame, learner: Learner, settings: ValidationSettings, seed: int) -> DataFrame:
    """(ids..., y, p) of the test rows, without recalibration."""
    keep = [*settings.ids, settings.label]
    pipeline = fit_pipeline(split.where(~F.col("is_test")), learner, settings, seed)
    return pipeline.score(split.where("is_test"), keep).select(
        *settings.ids, F.col(settings.label).alias("y"), "p"
    )


def calibrated_scores(split: DataFrame, learner: Learner, settings: ValidationSettings, seed: int) -> DataFrame:
    """(ids..., y, p) of the test rows from recalibrated models.

    The training rows are split again by group. For each inner fold a pipeline learns from
    the other folds, its calibrator from the fold itself, and the calibrated probabilities
    of all folds are averaged. Test rows take part in no fit.
    """
    keep = [*settings.ids, settings.label]
    test = split.where("is_test")
    train = spread(
        with_group_folds(
            split.where(~F.col("is_test")), settings.group, settings.label, seed, settings.inner_folds, "inner_fold"
        )
    )
    held, outer = [], []
    for k in range(settings.inner_folds):
        assert_groups_disjoint(train, settings.group, F.col("inner_fold") == k)
        pipeline = fit_pipeline(train.where(F.col("inner_fold") != k), learner, settings, seed)
        held.append(pipeline.score(train.where(F.col("inner_fold") == k), keep).withColumn("inner_fold", F.lit(k)))
        outer.append(pipeline.score(test, keep).withColumn("inner_fold", F.lit(k)))
    calibration = materialise(
        reduce(DataFrame.unionByName, held).select("inner_fold", F.col(settings.label).alias("y"), "margin")
    )
    lines = fit_sigmoid(calibration, ["inner_fold"])
    scored = reduce(DataFrame.unionByName, outer).withColumnRenamed(settings.label, "y")
    return recalibrated(scored, lines, "inner_fold", [*settings.ids, "y"])


def score_splits(
    splits: Iterable[tuple[int, int, DataFrame]], settings: ValidationSettings, unit: str, calibrate: bool
) -> DataFrame:
    """(model, unit, ids..., y, p) pooled over splits and learners."""
    parts = []
    for number, seed, split in splits:
        split = spread(split)
        for name, learner in settings.learners.items():
            score = calibrated_scores if calibrate else plain_scores
            scores = score(split, learner, settings, seed)
            parts.append(materialise(scores.select(F.lit(name).alias("model"), F.lit(number).alias(unit), "*")))
    return reduce(DataFrame.unionByName, parts)


def grouped_holdout_scores(frame: DataFrame, settings: ValidationSettings, repeats: int = presets.REPEATS) -> DataFrame:
    """Repeated group-disjoint hold-outs with recalibrated models."""

    def splits():
        for r in range(repeats):
            split = group_holdout(frame, settings.group, settings.label, settings.seed + r, settings.test_size)
            assert_groups_disjoint(split, settings.group)
            yield r, settings.seed + r, split

    return score_splits(splits(), settings, "repeat", True)


def grouped_cv_scores(frame: DataFrame, settings: ValidationSettings) -> DataFrame:
    """Group-disjoint cross-validation with recalibrated models."""
    assigned = materialise(
        with_group_folds(frame, settings.group, settings.label, settings.seed, settings.folds)
    )

    def splits():
        for k in range(settings.folds):
            split = assigned.withColumn("is_test", F.col("fold") == k).drop("fold")
            assert_groups_disjoint(split, settings.group)
            yield k + 1, settings.seed + k + 1, split

    return score_splits(splits(), settings, "fold", True)


def stratified_holdout_scores(frame: DataFrame, settings: ValidationSettings, repeats: int = presets.REPEATS) -> DataFrame:
    """Repeated label-stratified hold-outs, without grouping or recalibration."""

    def splits():
        for r in range(repeats):
            seed = settings.seed + r
            yield r, seed, stratified_holdout(frame, settings.label, settings.ids, seed, settings.test_size)

    return score_splits(splits(), settings, "repeat", False)


def stratified_cv_scores(frame: DataFrame, settings: ValidationSettings) -> DataFrame:
    """Label-stratified cross-validation, without grouping or recalibration."""
    assigned = materialise(stratified_folds(frame, settings.label, settings.ids, settings.seed, settings.folds))

    def splits():
        for k in range(settings.folds):
            yield k + 1, settings.seed + k + 1, assigned.withColumn("is_test", F.col("fold") == k).drop("fold")

    return score_splits(splits(), settings, "fold", False)


def metric_table(scores: DataFrame, unit: str, threshold: float = presets.THRESHOLD) -> DataFrame:
    """All metrics per model and split."""
    return all_metrics(scores, ["model", unit], threshold=threshold)


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Mean, std, min and max of every metric per model, four digits."""
    return group_summary(metrics, ["model"], METRICS, 4)
