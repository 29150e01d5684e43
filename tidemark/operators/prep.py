"""Train-only preprocessing: impute, clip, standardise, select."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.operators.selection import quantile_columns
from tidemark.session import small_frame


def model_frame(
    df: DataFrame, label: str = "mortality_label", keys: Sequence[str] = ("hadm_id", "subject_id")
) -> tuple[DataFrame, list[str]]:
    """Rows with a label, and the numeric columns that are neither label nor key."""
    features = [
        f.name
        for f in df.schema.fields
        if f.name != label and f.name not in keys and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    kept = [k for k in keys if k in df.columns]
    numbers = [F.col(c).cast("double").alias(c) for c in features]
    labelled = df.where(F.col(label).isNotNull())
    return labelled.select(*kept, F.col(label).cast("int").alias(label), *numbers), features


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value): one row per cell, for statistics of many columns at once."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features
    ])
    return df.select(*keep, F.inline(cells))


@dataclass(frozen=True)
class ColumnPrep:
    """Fitted numbers of one column."""

    feature: str
    median: float
    clip_low: float
    clip_high: float
    mean: float
    std: float

    def apply(self, scale: bool = True) -> Column:
        value = F.coalesce(F.col(self.feature).cast("double"), F.lit(self.median))
        clipped = F.least(F.greatest(value, F.lit(self.clip_low)), F.lit(self.clip_high))
        if not scale:
            return clipped.alias(self.feature)
        return ((clipped - F.lit(self.mean)) / F.lit(self.std)).alias(self.feature)


@dataclass(frozen=True)
class Preprocessor:
    """Imputes, clips and scales with numbers learnt from training rows only.

    There is one small record per column, so applying it is a projection without a join.
    Columns without any training value are dropped.
    """

    columns: tuple[ColumnPrep, ...]
    scale: bool = True

    @property
    def features(self) -> list[str]:
        return [c.feature for c in self.columns]

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        features: Sequence[str],
        clip: tuple[float, float] = (0.01, 0.99),
        scale: bool = True,
    ) -> Preprocessor:
        """Each step is fitted on the output of the step before; quantiles are exact.

        What reaches the driver is a few numbers per column.
        """
        centre = {f: q[0] for f, q in column_quantiles(train, features, [0.5]).items()}
        kept = [f for f in features if f in centre]
        filled = train.select(*[impute(f, centre[f]) for f in kept])
        bounds = column_quantiles(filled, kept, clip)
        clipped = filled.select(*[clip_to(f, *bounds[f]) for f in kept])
        moments = clipped.agg(*[
            part for f in kept for part in (F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"))
        ]).first()
        return cls(
            tuple(
                ColumnPrep(f, centre[f], *bounds[f], moments[f"{f}__m"], moments[f"{f}__s"] or 1.0)
                for f in kept
            ),
            scale,
        )

    def as_frame(self, spark) -> DataFrame:
        """The fitted numbers, one row per column."""
        numbers = ["median", "clip_low", "clip_high", "mean", "std"]
        schema = T.StructType(
            [T.StructField("feature", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in numbers]
        )
        return small_frame(spark, [(c.feature, *[getattr(c, n) for n in numbers]) for c in self.columns], schema)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *[c.apply(self.scale) for c in self.columns])


def column_quantiles(
    df: DataFrame, features: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float]]:
    """Exact quantiles of many columns; nulls are left out, columns without values are absent.

    All columns are selected from together; what reaches the driver is one row a column.
    """
    found = quantile_columns(to_long(df, features), ["feature"], "value", [float(q) for q in probabilities])
    by_feature = {row["feature"]: list(row["quantiles"]) for row in found.collect()}
    return {c: by_feature[c] for c in features if c in by_feature}


def impute(feature: str, centre: float) -> Column:
    return F.coalesce(F.col(feature).cast("double"), F.lit(float(centre))).alias(feature)


def clip_to(feature: str, low: float, high: float) -> Column:
    return F.least(F.greatest(F.col(feature), F.lit(float(low))), F.lit(float(high))).alias(feature)


def mutual_information(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 10, top: int | None = None
) -> DataFrame:
    """Mutual information (nats) between each quantile-binned feature and the label, highest first.

    Only (feature, bin, label) counts leave the map side.
    """
    long = to_long(df, features, [label]).where(F.col("value").isNotNull())
    cuts = quantile_columns(long, ["feature"], "value", [i / bins for i in range(1, bins)])
    edges = cuts.select("feature", F.col("quantiles").alias("__edges"))
    binned = long.join(F.broadcast(edges), "feature").select(
        "feature",
        label,
        F.size(F.filter("__edges", lambda edge: edge < F.col("value"))).alias("bin"),
    )
    cells = binned.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy("feature"))
    in_bin = F.sum("__n").over(Window.partitionBy("feature", "bin"))
    in_class = F.sum("__n").over(Window.partitionBy("feature", label))
    parts = cells.select("feature", "__n", total.alias("__t"), in_bin.alias("__b"), in_class.alias("__c"))
    gain = F.col("__n") / F.col("__t") * F.log(
        F.col("__n").cast("double") * F.col("__t") / (F.col("__b").cast("double") * F.col("__c"))
    )
    scored = parts.groupBy("feature").agg(F.sum(gain).alias("mutual_information"))
    ranked = scored.orderBy(F.desc("mutual_information"), "feature")
    return ranked if top is None else ranked.limit(top)
