"""Classifiers with balanced classes (MLlib, and boosted trees of our own), scoring and sigmoid recalibration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.boosting import BoostedTrees, fit_boosted
from tidemark.operators.evaluate import logistic_line
from tidemark.operators.splits import with_balanced_weights
from tidemark.session import small_frame


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="error").transform(df)


@dataclass(frozen=True)
class FittedModel:
    """A fitted classifier with the columns it reads."""

    model: Model
    features: tuple[str, ...]
    has_margin: bool

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., p, margin): probability of class 1 and the score that recalibration uses.

        The margin is the decision value of a linear model and the probability of a forest.
        """
        scored = self.model.transform(_assembled(df, self.features))
        p = vector_to_array("probability")[1]
        margin = vector_to_array("rawPrediction")[1] if self.has_margin else p
        return scored.select(*keep, p.alias("p"), margin.alias("margin"))

    def importances(self, spark) -> DataFrame:
        """(feature, importance), highest first; names line up with the columns read."""
        values = self.model.featureImportances.toArray()
        rows = [(f, float(v)) for f, v in zip(self.features, values)]
        schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
        return small_frame(spark, rows, schema).orderBy(F.desc("importance"), "feature")


def _without_summary(model: Model) -> Model:
    """The model without its training summary.

    A summary refers to the session. Models go to the executors with it, and a session that has
    observed a table cannot be serialised.
    """
    java = model._java_obj
    java.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def probability_of_margin(margin: Column) -> Column:
    """Logistic fallback for models that only give a margin."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit_logistic(
    train: DataFrame, features: Sequence[str], label: str, seed: int = 42, max_iter: int = 2000, c: float = 1.0
) -> FittedModel:
    """L2 logistic regression. Balanced weights add up to n, so strength ``c`` is 1/(c*n) here."""
    weighted = _assembled(with_balanced_weights(train, label, "__w"), features)
    rows = max(1, train.count())
    learner = LogisticRegression(
        featuresCol="__x", labelCol=label, weightCol="__w", maxIter=max_iter, regParam=1.0 / (c * rows),
        standardization=False, tol=1e-6,
    )
    return FittedModel(_without_summary(learner.fit(weighted)), tuple(features), True)


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str, seed: int = 42, trees: int = 300, depth: int = 30
) -> FittedModel:
    """Random forest, at least two rows per leaf. MLlib caps the depth at 30."""
    weighted = _assembled(with_balanced_weights(train, label, "__w"), features)
    learner = RandomForestClassifier(
        featuresCol="__x", labelCol=label, weightCol="__w", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024,
    )
    return FittedModel(_without_summary(learner.fit(weighted)), tuple(features), False)


Learner = Callable[..., FittedModel | BoostedTrees]

LEARNERS: Mapping[str, Learner] = {
    "Logistic Regression": fit_logistic,
    "Random Forest": fit_forest,
    "Gradient Boosting": fit_boosted,
}


def fit_sigmoid(
    held_out: DataFrame, by: Sequence[str], label: str = "y", margin: str = "margin"
) -> DataFrame:
    """(by..., intercept, slope): sigmoid calibrators of all groups fitted together.

    Targets are pulled in from 0 and 1 by the class sizes, so the fit stays finite even
    when the margin separates the classes.
    """
    is_pos = F.col(label) == 1
    sizes = held_out.groupBy(*by).agg(
        F.count_if(is_pos).alias("__n_pos"), F.count_if(~is_pos).alias("__n_neg")
    )
    target = F.when(is_pos, (F.col("__n_pos") + 1.0) / (F.col("__n_pos") + 2.0)).otherwise(
        F.lit(1.0) / (F.col("__n_neg") + 2.0)
    )
    rows = held_out.join(sizes, list(by)).select(*by, F.col(margin).alias("__m"), target.alias("__target"))
    return logistic_line(rows, "__m", "__target", by)


def recalibrated(
    scored: DataFrame, lines: DataFrame, fold: str, ids: Sequence[str], margin: str = "margin"
) -> DataFrame:
    """(ids..., p): calibrated probability of each fold's model, averaged over the folds."""
    joined = scored.join(F.broadcast(lines), fold)  # one line per inner fold
    p = probability_of_margin(F.col("intercept") + F.col("slope") * F.col(margin))
    return joined.groupBy(*ids).agg(F.avg(p).alias("p"))
