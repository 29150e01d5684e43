"""One reference interval per entity, from a table with many intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.clock import SECONDS_PER_HOUR, epoch_seconds


def envelope(
    intervals: DataFrame, key: str = "hadm_id", start: str = "intime", end: str = "outtime"
) -> DataFrame:
    """Earliest start and latest end per entity; intervals without a start are left out."""
    return (
        intervals.where(F.col(start).isNotNull())
        .groupBy(key)
        .agg(F.min(start).alias("ref_start"), F.max(end).alias("ref_end"))
    )


def first_start(intervals: DataFrame, key: str = "hadm_id", start: str = "intime") -> DataFrame:
    """Earliest start per entity."""
    return intervals.where(F.col(start).isNotNull()).groupBy(key).agg(F.min(start).alias("ref_start"))


def first_interval(
    intervals: DataFrame,
    key: str = "hadm_id",
    start: str = "intime",
    end: str = "outtime",
    tie: str = "icustay_id",
) -> DataFrame:
    """The complete interval that starts first; equal starts are decided by ``tie``.

    A minimum over (start, tie, end) combines on the map side, where a ranking window
    would bring all intervals of a hot entity into one task.
    """
    whole = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    picked = whole.groupBy(key).agg(
        F.min(F.struct(F.col(start), F.col(tie), F.col(end))).alias("__first")
    )
    return picked.select(
        key,
        F.col("__first")[start].alias("ref_start"),
        F.col("__first")[end].alias("ref_end"),
        F.col("__first")[tie].alias(tie),
    )


def eligible_start(
    intervals: DataFrame,
    min_hours: float,
    key: str = "hadm_id",
    start: str = "intime",
    end: str = "outtime",
    tie: str = "icustay_id",
) -> DataFrame:
    """Start of the first interval of entities whose first interval lasts ``min_hours`` or more.

    Only the start leaves this function: the end must never become a feature.
    """
    first = first_interval(intervals, key, start, end, tie)
    length = epoch_seconds(first, "ref_end") - epoch_seconds(first, "ref_start")
    return first.where(length >= F.lit(float(min_hours) * SECONDS_PER_HOUR)).select(key, "ref_start")


def stay_summary(
    intervals: DataFrame,
    key: str = "hadm_id",
    length: str = "icu_los_days",
    stay: str = "icustay_id",
    prefix: str = "icu",
) -> DataFrame:
    """Mean and total interval length and number of distinct intervals per entity."""
    return intervals.groupBy(key).agg(
        F.avg(length).alias(f"{prefix}_los_mean"),
        F.sum(length).alias(f"{prefix}_los_total"),
        F.countDistinct(stay).cast("double").alias(f"{prefix}_stay_count"),
    )
