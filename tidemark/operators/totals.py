"""Per-entity measures of an event stream, exact medians included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.measures import feature_measures
from tidemark.operators.selection import quantile_columns


def entity_medians(events: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``<feature>_median`` per ``key``: the smallest value that at least half of the values do not exceed.

    One method at every size: radix selection by (key, feature). Entities without a value of
    any of the features are absent.
    """
    known = events.where(F.col("feature").isin(*features)).select(key, "feature", "value")
    middle = quantile_columns(known, [key, "feature"], "value", [0.5], interpolate=False)
    return middle.groupBy(key).agg(*[
        F.max(F.when(F.col("feature") == f, F.get("quantiles", F.lit(0)))).alias(f"{f}_median") for f in features
    ])


def entity_measures(
    events: DataFrame,
    key: str,
    features: Sequence[str],
    measures: Sequence[str],
    extra: Sequence[Column] = (),
    median_events: DataFrame | None = None,
) -> DataFrame:
    """``<feature>_<measure>`` and ``extra`` aggregates, one row per ``key``.

    All measures but the median combine into a few numbers per task, in one aggregation; medians
    are selected exactly and joined to them, one row an entity on either side. ``median_events`` may give the same
    (key, feature, value) rows by a shorter plan than ``events``, as medians read them twice.
    """
    plain = [m for m in measures if m != "median"]
    columns = [*feature_measures(features, plain), *extra]
    combined = events.groupBy(key).agg(*columns) if columns else events.select(key).distinct()
    if "median" not in measures:
        return combined
    medians = entity_medians(events if median_events is None else median_events, key, features).withColumnRenamed(key, "__key")
    joined = combined.join(medians, F.col(key).eqNullSafe(F.col("__key")), "left")
    own = [c for c in combined.columns if c != key][len(features) * len(plain):]
    return joined.select(key, *[f"{f}_{m}" for f in features for m in measures], *own)
