"""Time arithmetic in whole epoch seconds.

Sub-second parts are cut off *before* subtracting, so a difference is always the
difference of two whole seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SECONDS_PER_HOUR = 3600


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 of the column ``name`` of ``df``.

    A zone-less timestamp is taken apart into calendar fields, so the result does not
    depend on the session time zone.
    """
    kind = df.schema[name].dataType
    ts = F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
        return days * F.lit(86400) + F.hour(ts) * F.lit(3600) + F.minute(ts) * F.lit(60) + F.second(ts)
    if isinstance(kind, T.DateType):
        return F.unix_date(ts).cast("long") * F.lit(86400)
    return F.unix_seconds(ts)


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours between two epoch-second columns."""
    return (later - earlier) / F.lit(float(SECONDS_PER_HOUR))


def window_index(elapsed_seconds: Column, window_hours: float) -> Column:
    """Index of the fixed-length window that ``elapsed_seconds`` falls into."""
    return F.floor(elapsed_seconds / F.lit(float(window_hours) * SECONDS_PER_HOUR)).cast("int")
