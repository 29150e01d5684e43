"""Reports on sources, cohorts and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def source_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one counting aggregate per table and nothing cached."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """(label, proportion) over rows with a label."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    return sizes.select(label, (F.col("__n") / total).alias("proportion"))


def missing_fraction(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, missing_fraction), highest first: one pass, one row, then unpivoted."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])
    long = shares.unpivot([], list(features), "feature", "missing_fraction")
    return long.orderBy(F.desc("missing_fraction"), "feature")


def cohort_flow(stages: Sequence[tuple[str, DataFrame]], patient: str) -> DataFrame:
    """(stage, n_rows, n_patients) for each stage, in order."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(patient).alias("n_patients")).select(
            F.lit(name).alias("stage"), "n_rows", "n_patients"
        )
        for name, df in stages
    ]
    return reduce(DataFrame.unionByName, parts)


def group_summary(
    df: DataFrame, by: Sequence[str], values: Sequence[str], digits: int | None = 2
) -> DataFrame:
    """``<value>_mean/_std/_min/_max`` per group, rounded."""

    def shown(column: Column) -> Column:
        return column if digits is None else F.round(column, digits)

    columns = []
    for v in values:
        columns += [
            shown(F.avg(v)).alias(f"{v}_mean"),
            shown(F.stddev_samp(v)).alias(f"{v}_std"),
            shown(F.min(v)).alias(f"{v}_min"),
            shown(F.max(v)).alias(f"{v}_max"),
        ]
    return df.groupBy(*by).agg(*columns)


def mean_std_text(summary: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``<value>_mean_std`` as text "mean ± std" with two decimals."""
    texts = [
        F.format_string("%.2f ± %.2f", F.col(f"{v}_mean"), F.col(f"{v}_std")).alias(f"{v}_mean_std")
        for v in values
    ]
    return summary.select(*keys, *texts)


def top_rows(df: DataFrame, measure: str, tie: str, n: int = 15) -> DataFrame:
    """The ``n`` rows with the largest measure."""
    return df.orderBy(F.desc(measure), tie).limit(n)
