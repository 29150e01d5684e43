"""Running sums inside groups by a prefix scan over range partitions.

Rows are dealt into ranges of (group, value). Ranges are summed up side by side; one sum per range and group is
carried on to the later ranges of the group. So a group that holds all rows still takes part in
every task, and what is exchanged by group alone is one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialise


def running_totals(df: DataFrame, by: Sequence[str], value: str | Sequence[str], totals: Sequence[str]) -> DataFrame:
    """For each row ``<total>_before``, the sum of ``total`` over the rows of its group with a smaller
    value, and ``<total>_all``, the sum over its group.

    ``value`` is a column or several, and must be unique inside a group: aggregate ties first. Where only rows
    without any total tie, their order changes nothing. Null keys are a group.
    """
    by, value = list(by), [value] if isinstance(value, str) else list(value)
    order = [F.col(c).asc_nulls_first() for c in (*by, *value)]
    ranged = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__range").agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(f"__sum_{t}") for t in totals])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(c).alias(f"__c_{c}") for c in by],
        F.col("__range").alias("__c_range"),
        *[F.coalesce(F.sum(f"__sum_{t}").over(earlier), F.lit(0)).alias(f"__carried_{t}") for t in totals],
        *[F.sum(f"__sum_{t}").over(group).alias(f"{t}_all") for t in totals],
    )
    same = F.col("__range") == F.col("__c_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    inside = Window.partitionBy("__range", *by).orderBy(*value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(carried, same)
    return placed.select(*df.columns, *[
        (F.col(f"__carried_{t}") + F.coalesce(F.sum(t).over(inside), F.lit(0))).alias(f"{t}_before") for t in totals
    ], *[f"{t}_all" for t in totals])
