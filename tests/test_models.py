"""Model fitting and leak-safe validation on a small frame."""

import random

import pytest
from pyspark.sql import Observation, functions as F

from tidemark.operators.models import fit_boosted, fit_forest, fit_logistic, probability_of_margin
from tidemark.plans import validation as v


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        x = rng.gauss(0, 1)
        data.append((i, i // 2, int(x + rng.gauss(0, 0.7) > 0.8), x if i % 11 else None, rng.random()))
    return spark.createDataFrame(data, "hadm_id long, subject_id long, mortality_label int, x double, noise double").cache()


def settings(**options):
    return v.ValidationSettings(["x", "noise"], learners={"Logistic Regression": fit_logistic}, **options)


def test_learners_score_probabilities(spark, frame):
    """Also after a table of the session was observed, which a model's training summary does not survive."""
    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    ready = frame.na.fill(0.0)
    for fit, options in ((fit_logistic, {}), (fit_forest, {"trees": 5, "depth": 5}), (fit_boosted, {"rounds": 3})):
        model = fit(ready, ["x", "noise"], "mortality_label", **options)
        scores = model.score(ready, ["hadm_id"])
        low, high, n = scores.agg(F.min("p"), F.max("p"), F.count("*")).first()
        assert 0.0 <= low < high <= 1.0 and n == 400
        if fit is not fit_logistic:
            assert model.importances(spark).first()["feature"] == "x"
    assert spark.range(1).select(probability_of_margin(F.lit(0.0))).first()[0] == 0.5


def test_logistic_strength_matches_the_penalised_optimum(frame):
    """Gradient of  0.5 * |w|^2 + sum(weight * loss)  is zero at the fitted coefficients."""
    ready = frame.na.fill(0.0)
    model = fit_logistic(ready, ["x", "noise"], "mortality_label").model
    n = ready.count()
    sizes = {r["mortality_label"]: r["count"] for r in ready.groupBy("mortality_label").count().collect()}
    w, b = model.coefficients, model.intercept
    line = F.lit(float(w[0])) * F.col("x") + F.lit(float(w[1])) * F.col("noise") + F.lit(float(b))
    weight = F.when(F.col("mortality_label") == 1, n / (2 * sizes[1])).otherwise(n / (2 * sizes[0]))
    rest = weight * (F.lit(1.0) / (F.lit(1.0) + F.exp(-line)) - F.col("mortality_label"))
    g = ready.agg(F.sum(rest * F.col("x")), F.sum(rest * F.col("noise")), F.sum(rest)).first()
    assert g[0] + w[0] == pytest.approx(0.0, abs=0.05) and g[1] + w[1] == pytest.approx(0.0, abs=0.05)
    assert g[2] == pytest.approx(0.0, abs=0.05)


def test_grouped_holdout_with_recalibration(frame):
    scores = v.grouped_holdout_scores(frame, settings(inner_folds=2), repeats=1)
    assert scores.columns == ["model", "repeat", "hadm_id", "y", "p"]
    joined = scores.join(frame, "hadm_id")
    test_groups = {r["subject_id"] for r in joined.select("subject_id").distinct().collect()}
    assert joined.count() == frame.where(F.col("subject_id").isin(list(test_groups))).count()
    metrics = v.metric_table(scores, "repeat").first()
    assert metrics["auroc"] > 0.8
    # Balanced weights alone would predict far too high on average.
    mean_p, rate = scores.agg(F.avg("p"), F.avg("y")).first()
    assert abs(mean_p - rate) < 0.08


def test_stratified_cv_covers_every_row_once(frame):
    scores = v.stratified_cv_scores(frame, settings(folds=2, top_features=1))
    assert scores.count() == 400 and scores.select("hadm_id").distinct().count() == 400
    summary = v.metric_summary(v.metric_table(scores, "fold")).first()
    assert summary["auroc_min"] <= summary["auroc_mean"] <= summary["auroc_max"]
