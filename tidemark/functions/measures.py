"""Measures of one feature of an event stream, as aggregate columns.

Every measure is built from aggregates that Spark combines on the map side, so a hot
entity costs one partial row per task instead of a long sort in one task. Medians, which do not
combine so, are in ``operators.totals``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

MEASURES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "count": lambda v: F.count(v).cast("double"),
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
}


def feature_measures(
    features: Sequence[str],
    measures: Sequence[str],
    feature: str = "feature",
    value: str = "value",
) -> list[Column]:
    """``<feature>_<measure>`` columns, feature by feature.

    A count is 0.0 for an entity that only has events of other features; the remaining
    measures are null there.
    """
    unknown = [m for m in measures if m not in MEASURES]
    if unknown:
        raise ValueError(f"unknown measures {unknown}; known: {sorted(MEASURES)}")
    return [
        MEASURES[m](F.when(F.col(feature) == f, F.col(value))).alias(f"{f}_{m}")
        for f in features
        for m in measures
    ]


def bounded_means(
    features: Sequence[str],
    hours: Sequence[int],
    elapsed_hours: Column,
    from_reference: bool = False,
    feature: str = "feature",
    value: str = "value",
) -> list[Column]:
    """``<feature>_mean_<h>h``: mean over events at most ``h`` hours after the reference.

    By default events before the reference time count too; ``from_reference`` bounds the
    window below by the reference time.
    """
    columns = []
    for f in features:
        for h in hours:
            inside = (F.col(feature) == f) & (elapsed_hours <= F.lit(float(h)))
            if from_reference:
                inside = inside & (elapsed_hours >= F.lit(0.0))
            columns.append(F.avg(F.when(inside, F.col(value))).alias(f"{f}_mean_{h}h"))
    return columns


def trends(
    features: Sequence[str],
    order: Sequence[Column],
    placed: Column | None = None,
    feature: str = "feature",
    value: str = "value",
) -> list[Column]:
    """``<feature>_trend``: last value minus first value in ``order``.

    ``placed`` restricts the events that take part. The first and last values come from
    ``min_by``/``max_by`` in the same aggregation, so no window sort is needed; give
    ``order`` a tie-breaker to make the result unique.
    """
    columns = []
    for f in features:
        inside = F.col(feature) == f
        if placed is not None:
            inside = inside & placed
        position = F.when(inside, F.struct(*order))
        first, last = F.min_by(F.col(value), position), F.max_by(F.col(value), position)
        columns.append((last - first).alias(f"{f}_trend"))
    return columns
