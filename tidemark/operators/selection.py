"""Exact order statistics of every group by radix selection, at every size.

Rows are counted per group and leading digit of the value; counting combines on the map side,
so a group that holds most of the rows sends a bounded number of counts from each task. The counts tell which
digits hold the wanted ranks. Only rows of those digits are read again, by their next digit,
until a digit holds one value, few rows, or the wanted row as its least or greatest. No group is sorted and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import BROADCAST_ROWS, materialise

# Digits a bucket is divided into from the second round on.
RADIX = 4096
# Leading digits for each doubling of the magnitude; all doubles have fewer than 2 * FAR of them.
PER_OCTAVE = 16
FAR = 40_000
# A bucket of no more rows than this is sorted instead of divided on.
SORTED_ROWS = 4096
_ALL = "__all"


def leading_digit(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises: sixteen steps for each doubling of its size.

    Infinities and NaN, which is above all numbers, have digits of their own.
    """
    size = F.floor(F.log2(F.abs(value)) * F.lit(float(PER_OCTAVE))) + F.lit(FAR // 2)
    return (
        F.when(F.isnan(value), F.lit(FAR + 1))
        .when(value == F.lit(float("inf")), F.lit(FAR))
        .when(value == F.lit(float("-inf")), F.lit(-FAR))
        .when(value > 0, size)
        .when(value < 0, -size)
        .otherwise(F.lit(0))
        .cast("int")
    )


def next_digit(value: Column, low: Column, high: Column) -> Column:
    """Which of ``RADIX`` equal steps from ``low`` to ``high`` holds ``value``; never falls as it rises.

    The ends get the first and the last digit, so every round divides a bucket of two values or more.
    """
    # Halves, as the distance of two large numbers of unlike sign may not be a number.
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(value >= high, F.lit(RADIX - 1)).when(value <= low, F.lit(0)).otherwise(
        F.least(F.floor(share * F.lit(float(RADIX))), F.lit(RADIX - 1)).cast("int")
    )


def _same(keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return condition


def _ranked(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buckets (keys, __start, __digit, __n, ...) with the number of their group's rows below them."""
    below = Window.partitionBy(*keys, "__start").orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__below", F.col("__start") + F.coalesce(F.sum("__n").over(below), F.lit(0)))


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "__start", "__digit").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")
    )


def _holding(buckets: DataFrame) -> DataFrame:
    """Buckets that hold a wanted rank, with the ranks they hold."""
    inside = F.filter("__ranks", lambda rank: (rank >= F.col("__below")) & (rank < F.col("__below") + F.col("__n")))
    return buckets.withColumn("__ranks", inside).where(F.size("__ranks") > 0)


def _opened(rows: DataFrame, hits: DataFrame, keys: Sequence[str], broadcast: bool) -> DataFrame:
    """Rows of the buckets in ``hits``, with what ``hits`` tells of their bucket."""
    named = hits.select(
        *[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__start").alias("__o_start"), F.col("__digit").alias("__o_digit"),
        "__below", "__low", "__high", "__ranks", "__total",
    )
    at = _same(keys, "__o_") & (F.col("__start") == F.col("__o_start")) & (F.col("__digit") == F.col("__o_digit"))
    return rows.join(F.broadcast(named) if broadcast else named, at).drop("__o_start", "__o_digit", *[f"__o_{k}" for k in keys])


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Column) -> DataFrame:
    """(by..., __total, __found): rows with a value per group, and a map from rank to the value of that rank.

    ``ranks`` is an array of 0-based ranks computed from the column ``__total``. Nulls are left out; groups without values
    are absent; null keys are a group. The table is read twice; later rounds read the rows of open buckets alone.
    """
    keys = list(by) or [_ALL]
    group = [F.col(k) for k in by] or [F.lit(0).alias(_ALL)]
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__start", F.lit(0).cast("long")).withColumn("__digit", leading_digit(F.col("__v")))
    first = _ranked(_counted(rows, keys), keys)
    first = first.withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys, "__start")))
    hits = materialise(_holding(first.withColumn("__ranks", F.array_distinct(ranks))))
    found = []
    # The ends of a bucket are known, and so is all of a bucket with one value.
    one_value = F.col("__low").eqNullSafe(F.col("__high"))
    last = F.col("__below") + F.col("__n") - 1
    known = F.filter("__ranks", lambda rank: one_value | (rank == F.col("__below")) | (rank == last))
    while True:
        ends = F.transform(known, lambda rank: F.struct(
            rank.alias("__rank"), F.when(rank == F.col("__below"), F.col("__low")).otherwise(F.col("__high")).alias("__at")
        ))
        found.append(hits.select(*keys, "__total", F.inline(ends)))
        open_ = hits.withColumn("__ranks", F.array_except("__ranks", known)).where(F.size("__ranks") > 0)
        few = F.col("__n") <= SORTED_ROWS
        n_few, n_many = open_.agg(F.count_if(few), F.count_if(~few)).first()
        if n_few:
            bucket = _opened(rows, open_.where(few), keys, n_few <= BROADCAST_ROWS).groupBy(*keys, "__start", "__digit").agg(
                F.first("__total").alias("__total"), F.first("__below").alias("__below"), F.first("__ranks").alias("__ranks"),
                F.sort_array(F.collect_list("__v")).alias("__values"),
            )
            picked = F.transform("__ranks", lambda rank: F.struct(
                rank.alias("__rank"), F.get("__values", (rank - F.col("__below")).cast("int")).alias("__at")
            ))
            found.append(bucket.select(*keys, "__total", F.inline(picked)))
        if not n_many:
            break
        deeper = _opened(rows, open_.where(~few), keys, n_many <= BROADCAST_ROWS)
        rows = materialise(deeper.select(
            *keys, "__v", F.col("__below").alias("__start"), next_digit(F.col("__v"), F.col("__low"), F.col("__high")).alias("__digit"),
        ))
        wanted = open_.where(~few).select(*[F.col(k).alias(f"__w_{k}") for k in keys], F.col("__below").alias("__w_start"), "__ranks", "__total")
        counted = _ranked(_counted(rows, keys), keys).join(wanted, _same(keys, "__w_") & (F.col("__start") == F.col("__w_start")))
        hits = materialise(_holding(counted.drop("__w_start", *[f"__w_{k}" for k in keys])))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    entries = F.map_from_entries(F.collect_list(F.struct("__rank", "__at")))
    result = whole.groupBy(*keys).agg(F.max("__total").alias("__total"), entries.alias("__found"))
    return result.select(*by, "__total", "__found")


def quantile_columns(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], interpolate: bool = True
) -> DataFrame:
    """(by..., quantiles): one array per group, in the order of ``probabilities``."""
    asked = F.lit([float(p) for p in probabilities])
    total = F.col("__total").cast("double")

    def position(p: Column) -> Column:
        return p * (total - F.lit(1.0)) if interpolate else F.greatest(F.ceil(p * total) - F.lit(1), F.lit(0)).cast("double")

    def ranks(p: Column) -> Column:
        return F.array(F.floor(position(p)), F.ceil(position(p)))

    def between(p: Column) -> Column:
        at = position(p)
        low, high = F.element_at("__found", F.floor(at)), F.element_at("__found", F.ceil(at))
        # Between two equal infinities there is no difference to take a share of.
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    found = order_statistics(df, by, value, F.flatten(F.transform(asked, ranks)))
    return found.select(*by, F.transform(asked, between).alias("quantiles"))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], interpolate: bool = True
) -> DataFrame:
    """Exact quantiles: one row (by..., probability, quantile).

    Linearly interpolated, or else the smallest value that at least the asked share of the rows does not
    exceed. Nulls are left out.
    """
    asked = F.lit([float(p) for p in probabilities]).alias("probability")
    found = quantile_columns(df, by, value, probabilities, interpolate)
    return found.select(*by, F.inline(F.arrays_zip(asked, F.col("quantiles").alias("quantile"))).alias("probability", "quantile"))
