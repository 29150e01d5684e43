"""Loading, rounding and registration shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Added before rounding so that exact halves (sums of few two-decimal values divided by a
# power of two) round the same way whatever the summation order was.
NUDGE = 1e-9
DIGITS = 6


@dataclass(frozen=True)
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column | str, digits: int = DIGITS) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + F.lit(NUDGE * 10.0 ** (DIGITS - digits)), digits) + F.lit(0.0)


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All double columns rounded for comparison."""
    return df.select(*[
        rounded(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expression: str, name: str, digits: int = DIGITS) -> str:
    """SQL twin of ``rounded``."""
    nudge = f"{NUDGE * 10.0 ** (DIGITS - digits):.12f}"
    return f"round(CAST({expression} AS DOUBLE) + CAST({nudge} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


def rs(names: Iterable[str], digits: int = DIGITS) -> str:
    return ", ".join(r(n, n, digits) for n in names)
