"""Joins of a large table to a table with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEAVY_SHARE = 1 / 512


class KeyNotUnique(ValueError):
    """A side that must have one row per key has more."""


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; reads statistics only and starts no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scanned_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads; unlike ``planned_bytes`` it is not blurred by joins."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's automatic broadcast limit in bytes (-1 when switched off)."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size rule will broadcast ``df``."""
    return planned_bytes(df) <= broadcast_limit(df.sparkSession)


def measured_size(df: DataFrame, key: str, fixed: int = 64) -> int:
    """Bytes of a (key, few fixed-width columns) table, counted."""
    width = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.lit(fixed)
    return int(df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0])


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Every key holding more than ``share`` of the rows; never more than 1/share keys.

    One pass over the key column with a frequent-items sketch. The sketch may name keys
    that are not heavy, which costs nothing but their place in the list. Null is a key here.
    """
    return list(df.stat.freqItems([key], share).first()[0] or [])


def is_one_of(key: str, keys: Sequence) -> Column:
    """Membership test that never is null and takes null as a key."""
    member = F.coalesce(F.col(key).isin([k for k in keys if k is not None]), F.lit(False))
    return member | F.col(key).isNull() if None in keys else member


def many_to_one(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "inner",
    share: float = HEAVY_SHARE,
    measured_bytes: int | None = None,
) -> DataFrame:
    """Join ``many`` to ``one`` (unique on ``key``), safe when a key holds a large part of ``many``.

    A small ``one`` is left to Spark's size-checked broadcast. Otherwise the heavy keys
    are found first: their rows of ``one`` number at most 1/share and are broadcast, so
    the heavy rows of ``many`` are not shuffled at all, and the remaining rows go through
    an ordinary shuffle join with no heavy key left in it.

    Catalyst multiplies sizes over joins, which overstates a ``one`` that was itself
    joined together; a caller that has measured it passes ``measured_bytes``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join type must be inner or left, not {how!r}")
    if fits_broadcast(one):
        return many.join(one, key, how)
    if measured_bytes is not None and measured_bytes <= broadcast_limit(many.sparkSession):
        return many.join(F.broadcast(one), key, how)
    heavy = heavy_keys(many, key, share)
    if not heavy:
        return many.join(one, key, how)
    # Rows with a null key match nothing; a left join keeps them, without shuffling them together.
    is_heavy = is_one_of(key, heavy)
    near = many.where(is_heavy).join(F.broadcast(one.where(is_heavy)), key, how)
    far = many.where(~is_heavy).join(one.where(~is_heavy), key, how)
    return near.unionByName(far)


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> None:
    """Raise with up to five offending keys if ``keys`` do not identify the rows."""
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1).limit(5).collect()
    if repeated:
        shown = [tuple(row[k] for k in keys) for row in repeated]
        raise KeyNotUnique(f"{name}: {list(keys)} not unique, for example {shown}")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join after checking that ``key`` is unique on both sides."""
    assert_unique(left, [key], "left side")
    assert_unique(right, [key], "right side")
    return left.join(right, key, "inner")
