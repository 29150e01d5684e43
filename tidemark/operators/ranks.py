"""Seeded global ranks without a single-task sort.

A window over a whole table, or over a stratum that holds a third of it, runs in one task.
Ranks work on two levels instead: rows are put into order-preserving buckets, bucket totals are
summed up (a bounded number of rows per group), and only the rows inside one bucket are
sorted together. Running sums are in ``scan``, quantiles in ``selection``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_DIGITS = 3
_ONE = "__all"


def seeded_hash(seed: int | Column, *ids: str) -> Column:
    """md5 of seed and identifiers: a reproducible random order, equal in any engine."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("-", first, *[F.col(c).cast("string") for c in ids]))


def _offsets(sizes: DataFrame, by: Sequence[str], bucket: str, totals: Sequence[str]) -> DataFrame:
    """Sum of ``totals`` over all lower buckets of the same group."""
    below = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *by, bucket, *[F.coalesce(F.sum(t).over(below), F.lit(0)).alias(f"__below_{t}") for t in totals]
    )


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    seed: int | Column,
    ids: Sequence[str],
    name: str = "position",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """1-based rank of every row inside its ``by`` group in seeded-hash order.

    The leading hash digits are the bucket. They spread evenly whatever the data looks
    like, so a group holding half of the rows is still sorted in 16**digits pieces.
    ``ids`` must identify the rows.
    """
    by = list(by)
    shuffled = df.withColumn("__order", seeded_hash(seed, *ids))
    shuffled = shuffled.withColumn("__bucket", F.substring("__order", 1, digits))
    sizes = shuffled.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__filled"))
    below = _offsets(sizes, by, "__bucket", ["__filled"]) if by else _offsets(
        sizes.withColumn(_ONE, F.lit(0)), [_ONE], "__bucket", ["__filled"]
    ).drop(_ONE)
    inside = Window.partitionBy(*by, "__bucket").orderBy("__order", *ids)
    ranked = shuffled.withColumn("__inside", F.row_number().over(inside))
    return _join_null_safe(ranked, below, [*by, "__bucket"]).withColumn(
        name, (F.col("__inside") + F.col("__below___filled")).cast("long")
    ).drop("__order", "__bucket", "__inside", "__below___filled")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that also matches null group keys; keys are kept once."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition).drop(*[f"__r_{k}" for k in keys])
