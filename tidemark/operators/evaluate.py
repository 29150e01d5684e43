"""Evaluation of scored predictions as Spark aggregations.

A scored table has a 0/1 label, a probability and any number of grouping columns
(``by``: model, repeat, fold). Rank-based metrics first add up equal probabilities, then
take running totals over range partitions, so no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from tidemark.operators.scan import running_totals
from tidemark.operators.selection import quantile_columns
from tidemark.session import broadcast_if_small, materialise, small_frame


def _ratio(top: Column, bottom: Column, empty: float | None) -> Column:
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def confusion_metrics(
    scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Counts at ``p >= threshold`` and the metrics derived from them.

    Precision, recall and F1 are 0 and specificity is null where undefined.
    """
    said, is_pos = F.col(p) >= F.lit(float(threshold)), F.col(y) == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(~said & ~is_pos).alias("tn"),
        F.count_if(said & ~is_pos).alias("fp"),
        F.count_if(~said & is_pos).alias("fn"),
        F.count_if(said & is_pos).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall, specificity = _ratio(tp, tp + fn, None), _ratio(tn, tn + fp, None)
    rates = F.filter(F.array(recall, specificity), lambda rate: rate.isNotNull())
    balanced = F.aggregate(rates, F.lit(0.0), lambda a, b: a + b) / F.size(rates)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.select(
        *by,
        _ratio(tp + tn, tp + tn + fp + fn, None).alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        _ratio(tp, tp + fp, 0.0).alias("precision"),
        F.coalesce(recall, F.lit(0.0)).alias("recall_sensitivity"),
        specificity.alias("specificity"),
        _ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn, 0.0).alias("f1"),
        _ratio(tp * tn - fp * fn, spread, 0.0).alias("mcc"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def _tied(scored: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct probability."""
    return scored.groupBy(*by, F.col(p).alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def threshold_counts(
    scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """Per distinct probability: its positives and negatives, true and false positives at
    that threshold, and the totals of the group."""
    joined = running_totals(_tied(scored, y, p, by), by, "threshold", ["pos", "neg"])
    return joined.select(
        *by,
        "threshold",
        "pos",
        "neg",
        F.col("neg_before"),
        (F.col("pos_all") - F.col("pos_before")).alias("tp"),
        (F.col("neg_all") - F.col("neg_before")).alias("fp"),
        F.col("pos_all").alias("all_pos"),
        F.col("neg_all").alias("all_neg"),
    )


def ranking_metrics(
    scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """AUROC (ties count half) and average precision; null if only one class is present."""
    counts = threshold_counts(scored, y, p, by)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    gained = F.sum(F.when(F.col("pos") > 0, F.col("pos") * precision))
    all_pos, all_neg = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    both = (all_pos > 0) & (all_neg > 0)
    return counts.groupBy(*by).agg(
        F.when(both, F.try_divide(wins, all_pos * all_neg)).alias("auroc"),
        F.when(both, F.try_divide(gained, all_pos)).alias("auprc"),
    )


def roc_points(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct probability, plus the origin (threshold null)."""
    counts = threshold_counts(scored, y, p, by)
    points = counts.select(
        *by,
        "threshold",
        F.try_divide(F.col("fp"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("all_pos")).alias("tpr"),
    )
    origin = scored.select(*by).distinct() if by else scored.sparkSession.range(1).select()
    return points.unionByName(origin.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    ))


def pr_points(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) for every distinct probability, plus the end point (null, 1, 0)."""
    counts = threshold_counts(scored, y, p, by)
    points = counts.select(
        *by,
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp"), F.col("all_pos")).alias("recall"),
    )
    end = scored.select(*by).distinct() if by else scored.sparkSession.range(1).select()
    return points.unionByName(end.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    ))


def brier_metrics(scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Brier score and skill against always predicting the group's own prevalence."""
    label = F.col(y).cast("double")
    score = F.avg((F.col(p) - label) * (F.col(p) - label))
    prevalence = F.avg(label)
    chance = prevalence * (F.lit(1.0) - prevalence)
    return scored.groupBy(*by).agg(
        score.alias("brier_score"),
        (F.lit(1.0) - F.try_divide(score, chance)).alias("brier_skill_score"),
    )


def reliability_curve(
    scored: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Mean prediction and observed rate per quantile bin; empty bins are absent.

    The bin of a prediction is the number of interior edges strictly below it.
    """
    by = list(by)
    keys = by or ["__all"]
    rows = scored if by else scored.withColumn("__all", F.lit(0))
    edges = quantile_columns(rows, keys, p, [i / bins for i in range(1, bins)])
    # One row a group, so rows of a hot group stay where they are.
    named = broadcast_if_small(materialise(edges.select(*[F.col(k).alias(f"__e_{k}") for k in keys], F.col("quantiles").alias("__edges"))))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__e_{k}"))
    binned = rows.join(named, condition).withColumn(
        "bin", F.size(F.filter("__edges", lambda edge: edge < F.col(p)))
    )
    return binned.groupBy(*by, "bin").agg(
        F.avg(p).alias("mean_predicted"),
        F.avg(F.col(y).cast("double")).alias("frac_positive"),
        F.count(F.lit(1)).alias("n"),
    )


def _newton_step(sums: Row, ridge: float) -> tuple[float, float]:
    g1 = sums["g1"] - ridge * sums["b"]
    h11 = sums["h11"] + ridge
    det = sums["h00"] * h11 - sums["h01"] ** 2
    if not det > 0.0:
        return 0.0, 0.0
    return (h11 * sums["g0"] - sums["h01"] * g1) / det, (sums["h00"] * g1 - sums["h01"] * sums["g0"]) / det


def logistic_line(
    rows: DataFrame,
    x: str,
    target: str,
    by: Sequence[str] = (),
    ridge: float = 0.0,
    iterations: int = 60,
    tolerance: float = 1e-10,
) -> DataFrame:
    """(by..., intercept, slope) of a one-variable logistic fit of ``target`` on ``x``.

    All groups are fitted together: one aggregation gives six sums per group, from which
    the driver takes a Newton step, halved whenever the loss went up. ``ridge`` penalises
    half the squared slope, never the intercept.
    """
    by = list(by)
    keys = by or ["__all"]
    points = rows if by else rows.withColumn("__all", F.lit(0))
    points = points.select(*keys, F.col(x).cast("double").alias("__x"), F.col(target).cast("double").alias("__t"))
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    spark = rows.sparkSession
    schema = T.StructType(
        [T.StructField(f"__f_{k}", points.schema[k].dataType) for k in keys]
        + [T.StructField("__a", T.DoubleType()), T.StructField("__b", T.DoubleType())]
    )
    try:
        groups = [tuple(row) for row in points.select(*keys).distinct().collect()]
        trial = {g: (0.0, 0.0) for g in groups}
        best = {g: (0.0, 0.0, float("inf")) for g in groups}
        moving = set(groups)
        for _ in range(iterations):
            if not moving:
                break
            coefficients = small_frame(spark, [(*g, *trial[g]) for g in moving], schema)
            for sums in _newton_sums(points, F.broadcast(coefficients), keys).collect():
                g = tuple(sums[k] for k in keys)
                a, b, loss = best[g]
                here = sums["loss"] + ridge * sums["b"] ** 2 / 2.0
                if here > loss + 1e-12 * abs(loss):
                    trial[g] = ((a + sums["a"]) / 2.0, (b + sums["b"]) / 2.0)
                else:
                    best[g] = (sums["a"], sums["b"], here)
                    step = _newton_step(sums, ridge)
                    trial[g] = (sums["a"] + step[0], sums["b"] + step[1])
                if max(abs(trial[g][0] - best[g][0]), abs(trial[g][1] - best[g][1])) < tolerance:
                    moving.discard(g)
    finally:
        points.unpersist()
    fitted = T.StructType(
        [points.schema[k] for k in keys] + [T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType())]
    )
    return small_frame(spark, [(*g, *best[g][:2]) for g in groups], fitted).select(*by, "intercept", "slope")


def _newton_sums(points: DataFrame, coefficients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loss, gradient and curvature of every group at its trial coefficients."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__f_{k}"))
    line = F.col("__a") + F.col("__b") * F.col("__x")
    at = points.join(coefficients, condition).withColumn("__line", line)
    at = at.withColumn("__mu", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__line"))))
    at = at.withColumn("__w", F.col("__mu") * (F.lit(1.0) - F.col("__mu")))
    rest = F.col("__t") - F.col("__mu")
    softplus = F.greatest(F.col("__line"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("__line")))
    return at.groupBy(*keys).agg(
        F.max("__a").alias("a"),
        F.max("__b").alias("b"),
        F.sum(softplus - F.col("__t") * F.col("__line")).alias("loss"),
        F.sum(rest).alias("g0"),
        F.sum(rest * F.col("__x")).alias("g1"),
        F.sum("__w").alias("h00"),
        F.sum(F.col("__w") * F.col("__x")).alias("h01"),
        F.sum(F.col("__w") * F.col("__x") * F.col("__x")).alias("h11"),
    )


def calibration_line(
    scored: DataFrame,
    y: str = "y",
    p: str = "p",
    by: Sequence[str] = (),
    eps: float = 1e-6,
    ridge: float = 1.0,
) -> DataFrame:
    """Calibration intercept and slope: logistic fit of the label on logit(p); null if one class."""
    by = list(by)
    keys = by or ["__all"]
    rows = scored if by else scored.withColumn("__all", F.lit(0))
    bounded = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1.0 - eps))
    logits = rows.withColumn("__logit", F.log(bounded / (F.lit(1.0) - bounded)))
    line = logistic_line(logits, "__logit", y, keys, ridge)
    classes = rows.groupBy(*keys).agg((F.min(y) < F.max(y)).alias("__both"))
    named = classes.select(*[F.col(k).alias(f"__c_{k}") for k in keys], "__both")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__c_{k}"))
    return line.join(named, condition).select(
        *by,
        F.when(F.col("__both"), F.col("intercept")).alias("calibration_intercept"),
        F.when(F.col("__both"), F.col("slope")).alias("calibration_slope"),
    )


METRICS = [
    "accuracy", "balanced_accuracy", "precision", "recall_sensitivity", "specificity", "f1", "mcc",
    "auroc", "auprc", "brier_score", "brier_skill_score", "calibration_intercept", "calibration_slope",
]


def all_metrics(
    scored: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", threshold: float = 0.5
) -> DataFrame:
    """Every metric, one row per group, rounded to six digits."""
    result = confusion_metrics(scored, y, p, by, threshold)
    for part in (ranking_metrics(scored, y, p, by), brier_metrics(scored, y, p, by), calibration_line(scored, y, p, by)):
        result = result.join(part, list(by), "left")
    counts = ["tn", "fp", "fn", "tp"]
    return result.select(*by, *[F.round(m, 6).alias(m) for m in METRICS], *counts)
