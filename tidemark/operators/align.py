"""Events placed on the clock of their entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.clock import SECONDS_PER_HOUR, epoch_seconds, window_index
from tidemark.operators.joins import many_to_one


def on_entity_clock(
    events: DataFrame,
    reference: DataFrame,
    key: str = "hadm_id",
    time: str = "charttime",
    how: str = "inner",
    colocated: bool = False,
) -> DataFrame:
    """Attach the reference interval and ``elapsed_seconds`` since its start.

    Inner: events without a time or without a reference start are dropped. Left: they
    stay, with null ``elapsed_seconds``. ``colocated`` tables lie in buckets of ``key`` already, so hot keys are not
    looked for: nothing is moved.
    """
    if how == "inner":
        events = events.where(F.col(time).isNotNull())
        reference = reference.where(F.col("ref_start").isNotNull())
    joined = events.join(reference, key, how) if colocated else many_to_one(events, reference, key, how)
    elapsed = epoch_seconds(joined, time) - epoch_seconds(joined, "ref_start")
    return joined.withColumn("elapsed_seconds", elapsed)


def inside_interval(time: str = "charttime"):
    """Closed interval test; false when the interval has no end."""
    held = F.col(time).between(F.col("ref_start"), F.col("ref_end"))
    return F.coalesce(held, F.lit(False))


def clip_to_interval(placed: DataFrame, time: str = "charttime") -> DataFrame:
    """Keep events inside their reference interval, both ends included."""
    return placed.where(inside_interval(time))


def clip_counts(time: str = "charttime") -> list[Column]:
    """The aggregates of a clip audit."""
    kept = F.count_if(inside_interval(time))
    total = F.count(F.lit(1))
    return [
        total.alias("candidate_rows"),
        kept.alias("kept_rows"),
        (total - kept).alias("clipped_rows"),
        (F.lit(100.0) * F.try_divide(total - kept, total)).alias("clipped_percent"),
    ]


def clip_audit(placed: DataFrame, time: str = "charttime") -> DataFrame:
    """Candidate, kept and clipped event counts and the clipped share in percent."""
    return placed.agg(*clip_counts(time))


def within_first_hours(placed: DataFrame, hours: float) -> DataFrame:
    """Half-open window [0, hours) after the reference start."""
    limit = F.lit(float(hours) * SECONDS_PER_HOUR)
    return placed.where((F.col("elapsed_seconds") >= 0) & (F.col("elapsed_seconds") < limit))


def into_windows(placed: DataFrame, window_hours: float, name: str = "window_idx") -> DataFrame:
    """Fixed-length windows counted from the reference start; earlier events are dropped."""
    indexed = placed.withColumn(name, window_index(F.col("elapsed_seconds"), window_hours))
    return indexed.where(F.col(name) >= 0)
