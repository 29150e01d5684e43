"""Row-level expressions: labels, ages, indicators, flags and text repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def label_or_event(flag: str, event_time: str) -> Column:
    """Explicit 0/1 flag; where it is null, 1 if the event time is known, else 0."""
    happened = F.when(F.col(event_time).isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return F.coalesce(F.col(flag), happened).cast("int")


def age_years(at: str, born: str, cap_above: float | None = 89.0, cap_to: float = 90.0) -> Column:
    """Age in years; ages above ``cap_above`` become ``cap_to``, null stays null."""
    years = F.months_between(F.col(at), F.col(born)) / F.lit(12.0)
    if cap_above is None:
        return years
    return F.when(years > F.lit(float(cap_above)), F.lit(float(cap_to))).otherwise(years)


def category_indicator(column: str, category: str) -> Column:
    """1.0 where the text equals ``category`` ignoring case, else 0.0 (also for null)."""
    return F.when(F.upper(F.col(column)) == F.lit(category.upper()), F.lit(1.0)).otherwise(F.lit(0.0))


def is_abnormal(flag: str, normal: str = "normal", trim_both: bool = False) -> Column:
    """True for a non-blank flag other than ``normal``; false for null.

    The comparison with ``normal`` looks at the untrimmed text unless ``trim_both``.
    """
    text = F.lower(F.trim(F.col(flag)) if trim_both else F.col(flag))
    abnormal = (F.trim(F.col(flag)) != F.lit("")) & (text != F.lit(normal))
    return F.coalesce(abnormal, F.lit(False))


def with_missing_flags(
    df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Append ``<column>_missing`` (1.0/0.0) for ``columns``, or for all non-key columns.

    A name that ``df`` does not have raises.
    """
    if columns is None:
        columns = [c for c in df.columns if c not in keys and not c.endswith("_missing")]
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    flags = [F.when(F.col(c).isNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_missing") for c in columns]
    return df.select("*", *flags)


def decimal_from_text(column: str) -> Column:
    """Number from text with a decimal comma or point; unparsable text becomes null."""
    return F.replace(F.col(column).cast("string"), F.lit(","), F.lit(".")).try_cast("double")
