"""Preprocessing and metrics against single-machine results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators import evaluate as ev
from tidemark.operators.models import fit_sigmoid, recalibrated
from tidemark.operators.prep import Preprocessor, column_quantiles, model_frame, mutual_information

RNG = random.Random(3)


def table(spark):
    data = []
    for i in range(401):
        data.append((i, RNG.gauss(5, 2) if i % 7 else None, 1e6 if i == 3 else float(i % 10), 4.0, None, i % 2))
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y int")


def test_preprocessing_learns_from_training_rows_only(spark):
    df = table(spark)
    train = df.where("id < 300")
    fitted = Preprocessor.fit(train, ["a", "b", "c", "d"])
    assert fitted.features == ["a", "b", "c"]
    pdf, whole = train.toPandas(), df.toPandas()
    out = fitted.transform(df, ["id"]).toPandas().sort_values("id")
    for f in fitted.features:
        filled = pdf[f].fillna(pdf[f].median())
        low, high = np.quantile(filled, [0.01, 0.99])
        clipped = filled.clip(low, high)
        sd = clipped.std(ddof=0) or 1.0
        expected = (whole[f].fillna(pdf[f].median()).clip(low, high) - clipped.mean()) / sd
        assert np.allclose(out[f], expected, rtol=1e-9, atol=1e-9), f
    assert (out["c"] == 0.0).all()
    assert fitted.as_frame(spark).count() == 3


def test_column_quantiles_leave_out_empty_columns(spark):
    df = table(spark)
    found = column_quantiles(df, ["a", "b", "d"], [0.01, 0.5])
    assert sorted(found) == ["a", "b"]
    assert all(found[c] == pytest.approx(np.quantile(df.toPandas()[c].dropna(), [0.01, 0.5])) for c in found)


def test_model_frame_drops_keys_text_and_unlabelled_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 2.5, "x"), (2, 1, None, 1.0, "y")],
        "hadm_id long, subject_id long, mortality_label int, age double, note string",
    )
    frame, features = model_frame(df)
    assert features == ["age"] and frame.count() == 1
    assert frame.columns == ["hadm_id", "subject_id", "mortality_label", "age"]


def test_mutual_information_ranks_the_informative_column(spark):
    data = [(float(i % 2), RNG.random(), i % 2) for i in range(400)]
    df = spark.createDataFrame(data, "good double, noise double, y int")
    out = mutual_information(df, ["noise", "good"], "y").collect()
    assert out[0]["feature"] == "good" and out[0]["mutual_information"] == pytest.approx(math.log(2), rel=1e-6)
    assert mutual_information(df, ["noise", "good"], "y", top=1).count() == 1


def scored(spark, repeat=1):
    """Two models: one with heavy ties and the extremes, one with a single class."""
    data = []
    for i in range(600 * repeat):
        p = round(RNG.random() ** 2, 2)
        data.append(("m", int(RNG.random() < p), p))
    data += [("m", 1, 0.0), ("m", 0, 1.0), ("m", 1, 0.5)]
    data += [("single", 1, 0.2), ("single", 1, 0.7)]
    return data, spark.createDataFrame(data, "model string, y int, p double").repartition(5)


def brute_auroc(pairs):
    pos, neg = [p for y, p in pairs if y == 1], [p for y, p in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    n_pos, total, last = sum(y for y, _ in pairs), 0.0, 0
    for t in sorted({p for _, p in pairs}, reverse=True):
        said = [y for y, p in pairs if p >= t]
        total += (sum(said) - last) / n_pos * sum(said) / len(said)
        last = sum(said)
    return total


def brute_line(x, t, ridge):
    a = b = 0.0
    for _ in range(200):
        mu = 1 / (1 + np.exp(-(a + b * x)))
        w = mu * (1 - mu)
        g = np.array([np.sum(t - mu), np.sum((t - mu) * x) - ridge * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
    return a, b


def test_ranking_metrics_and_curves(spark):
    data, df = scored(spark)
    out = {r["model"]: r for r in ev.ranking_metrics(df, by=["model"]).collect()}
    pairs = [(y, p) for m, y, p in data if m == "m"]
    assert out["m"]["auroc"] == pytest.approx(brute_auroc(pairs)) and out["m"]["auprc"] == pytest.approx(brute_ap(pairs))
    assert out["single"]["auroc"] is None and out["single"]["auprc"] is None
    whole = ev.ranking_metrics(df).first()
    assert whole["auroc"] == pytest.approx(brute_auroc([(y, p) for _, y, p in data]))
    roc = ev.roc_points(df.where("model = 'm'"), by=["model"]).orderBy(F.desc_nulls_first("threshold")).collect()
    assert len(roc) == len({p for _, p in pairs}) + 1
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(roc, roc[1:]))
    assert area == pytest.approx(brute_auroc(pairs))
    pr = ev.pr_points(df.where("model = 'm'")).orderBy(F.desc_nulls_first("threshold")).collect()
    assert (pr[0]["precision"], pr[0]["recall"]) == (1.0, 0.0) and pr[-1]["recall"] == 1.0


def test_metrics_of_one_model_without_broadcast(spark, without_broadcast):
    data, df = scored(spark)
    out = {r["model"]: r for r in ev.ranking_metrics(df, by=["model"]).collect()}
    pairs = [(y, p) for m, y, p in data if m == "m"]
    assert out["m"]["auroc"] == pytest.approx(brute_auroc(pairs)) and out["m"]["auprc"] == pytest.approx(brute_ap(pairs))


def test_confusion_metrics(spark):
    data = [("a", 1, 0.5), ("a", 1, 0.49), ("a", 0, 0.9), ("a", 0, 0.1), ("a", 1, 1.0),
            ("never", 1, 0.1), ("never", 0, 0.1), ("ones", 1, 0.9), ("ones", 1, 0.2)]
    df = spark.createDataFrame(data, "model string, y int, p double")
    out = {r["model"]: r for r in ev.confusion_metrics(df, by=["model"]).collect()}
    a = out["a"]
    assert (a["tn"], a["fp"], a["fn"], a["tp"]) == (1, 1, 1, 2)
    assert a["accuracy"] == 0.6 and a["f1"] == pytest.approx(2 / 3) and a["balanced_accuracy"] == pytest.approx((2 / 3 + 0.5) / 2)
    assert a["mcc"] == pytest.approx((2 * 1 - 1 * 1) / math.sqrt(3 * 3 * 2 * 2))
    assert (out["never"]["precision"], out["never"]["f1"], out["never"]["mcc"]) == (0.0, 0.0, 0.0)
    assert out["ones"]["specificity"] is None and out["ones"]["balanced_accuracy"] == 0.5


def test_brier_and_reliability(spark):
    data, df = scored(spark)
    pairs = np.array([(y, p) for m, y, p in data if m == "m"])
    y, p = pairs[:, 0], pairs[:, 1]
    out = {r["model"]: r for r in ev.brier_metrics(df, by=["model"]).collect()}
    score = np.mean((p - y) ** 2)
    assert out["m"]["brier_score"] == pytest.approx(score)
    assert out["m"]["brier_skill_score"] == pytest.approx(1 - score / (y.mean() * (1 - y.mean())))
    assert out["single"]["brier_skill_score"] is None
    edges = np.quantile(p, np.linspace(0, 1, 11))[1:-1]
    bins = np.searchsorted(edges, p)
    curve = rows(ev.reliability_curve(df.where("model = 'm'"), by=["model"]), "bin")
    assert [r["bin"] for r in curve] == sorted(set(bins))
    for r in curve:
        assert r["frac_positive"] == pytest.approx(y[bins == r["bin"]].mean())
        assert r["mean_predicted"] == pytest.approx(p[bins == r["bin"]].mean())


def test_calibration_line(spark):
    data, df = scored(spark)
    pairs = np.array([(y, min(max(p, 1e-6), 1 - 1e-6)) for m, y, p in data if m == "m"])
    a, b = brute_line(np.log(pairs[:, 1] / (1 - pairs[:, 1])), pairs[:, 0], 1.0)
    out = {r["model"]: r for r in ev.calibration_line(df, by=["model"]).collect()}
    assert out["m"]["calibration_intercept"] == pytest.approx(a, abs=1e-7)
    assert out["m"]["calibration_slope"] == pytest.approx(b, abs=1e-7)
    assert out["single"]["calibration_slope"] is None


def test_sigmoid_calibrators_of_several_folds(spark):
    data = [(k, int(RNG.random() < 1 / (1 + math.exp(-(k + m)))), m) for k in range(3) for m in np.linspace(-40, 40, 150).tolist()]
    data += [(3, int(m > 0), m) for m in np.linspace(-2, 2, 40).tolist()]  # separable
    df = spark.createDataFrame(data, "k int, y int, margin double")
    lines = {r["k"]: r for r in fit_sigmoid(df, ["k"]).collect()}
    for k in range(4):
        y = np.array([b for a, b, _ in data if a == k], dtype=float)
        x = np.array([c for a, _, c in data if a == k])
        n1, n0 = y.sum(), (1 - y).sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        loss = lambda a, b: np.sum(np.logaddexp(0, a + b * x) - t * (a + b * x))
        a, b = lines[k]["intercept"], lines[k]["slope"]
        best = loss(a, b)
        assert all(best <= loss(a + da, b + db) + 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
    test = spark.createDataFrame([(k, 7, 0.5) for k in range(4)], "k int, id long, margin double")
    p = recalibrated(test, fit_sigmoid(df, ["k"]), "k", ["id"]).first()["p"]
    expected = np.mean([1 / (1 + math.exp(-(lines[k]["intercept"] + 0.5 * lines[k]["slope"]))) for k in range(4)])
    assert p == pytest.approx(expected)


def test_all_metrics_has_one_row_per_group(spark):
    _, df = scored(spark)
    out = rows(ev.all_metrics(df, ["model"]), "model")
    assert len(out) == 2 and set(ev.METRICS) <= set(out[0])
