"""Mutual information of continuous columns with a class, from nearest neighbours in one dimension.

For each row the distance to its k-th nearest row of the same class is compared with how many rows of all classes
lie within it. Rows of one (column, class) are numbered in the order of their values by a prefix scan
and dealt into blocks of that order; each block also gets the k rows on either side, so blocks are worked on alone.
Rows within a distance are counted by a second scan that sorts ends of intervals in among the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.prep import to_long
from tidemark.operators.scan import running_totals
from tidemark.session import materialise

# Distinct values of a column and class that are worked on together.
BLOCK = 50_000
_SHIFT = 10


def digamma(n: Column) -> Column:
    """Digamma of a positive number: its series after ten steps of the recurrence."""
    x = n.cast("double")
    steps = sum((F.lit(1.0) / (x + F.lit(float(j))) for j in range(1, _SHIFT)), F.lit(1.0) / x)
    z = x + F.lit(float(_SHIFT))
    u = F.lit(1.0) / (z * z)
    series = u * (F.lit(1 / 12) - u * (F.lit(1 / 120) - u * (F.lit(1 / 252) - u * (F.lit(1 / 240) - u * F.lit(1 / 132)))))
    return F.log(z) - F.lit(0.5) / z - series - steps


def _radii(tied: DataFrame, label: str, neighbours: int) -> DataFrame:
    """(feature, label, value, n, n_class, k, radius): distance to the k-th nearest row of the same class.

    ``k`` is ``neighbours``, or one less than the class has rows. Rows of classes of one row are left out.
    """
    group = ["feature", label]
    placed = running_totals(tied.withColumn("__one", F.lit(1)), group, "value", ["n", "__one"])
    placed = placed.where(F.col("n_all") > 1).withColumn("k", F.least(F.lit(neighbours), F.col("n_all") - 1))
    at, block = F.col("__one_before"), F.floor(F.col("__one_before") / BLOCK)
    inside = at - block * BLOCK
    homes = F.concat(
        F.array(F.struct(block.alias("__block"), F.lit(True).alias("__own"))),
        F.when(inside < neighbours, F.array(F.struct((block - 1).alias("__block"), F.lit(False).alias("__own")))).otherwise(F.array().cast("array<struct<__block:bigint,__own:boolean>>")),
        F.when(inside >= BLOCK - neighbours, F.array(F.struct((block + 1).alias("__block"), F.lit(False).alias("__own")))).otherwise(F.array().cast("array<struct<__block:bigint,__own:boolean>>")),
    )
    dealt = placed.select(*group, "value", "n", F.col("n_all").alias("n_class"), "k", at.alias("__at"), F.inline(homes))
    order = Window.partitionBy(*group, "__block").orderBy("__at")

    def beside(step: int) -> Column:
        other = F.lag("value", step).over(order) if step > 0 else F.lead("value", -step).over(order)
        many = F.lag("n", step).over(order) if step > 0 else F.lead("n", -step).over(order)
        return F.struct(F.abs(F.col("value") - other).alias("far"), many.alias("many"))

    own = F.struct(F.lit(0.0).alias("far"), (F.col("n") - 1).alias("many"))
    near = F.array(own, *[beside(s) for j in range(1, neighbours + 1) for s in (j, -j)])
    ordered = F.array_sort(F.filter(near, lambda x: x["far"].isNotNull() & (x["many"] > 0)))
    start = F.struct(F.col("k").cast("long").alias("need"), F.lit(0.0).alias("far"))
    kth = F.aggregate(
        "__near", start,
        lambda seen, x: F.when(seen["need"] <= 0, seen).otherwise(F.struct((seen["need"] - x["many"]).alias("need"), x["far"].alias("far"))),
        lambda seen: seen["far"],
    )
    # The window is a step of its own: the aggregate reads its array once.
    return dealt.withColumn("__near", ordered).where("__own").select(*group, "value", "n", "n_class", "k", kth.alias("radius"))


def neighbour_information(
    df: DataFrame, features: Sequence[str], label: str, neighbours: int = 3, top: int | None = None
) -> DataFrame:
    """(feature, mutual_information) in nats between each column and the class, highest first; never below 0.

    The estimate is  psi(N) + <psi(k)> - <psi(N_class)> - <psi(m)>, where m counts the rows of any class
    closer than the k-th nearest row of the same class, the row itself included, or its equals where that distance is 0.
    Nulls of a column and rows without a class are left out, and so are classes of one row. No noise is
    added to break ties, so the estimate is reproducible.
    """
    cells = to_long(df.where(F.col(label).isNotNull()), features, [label]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    # -0.0 and 0.0 are one value.
    tied = cells.groupBy("feature", label, (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(_radii(tied, label, neighbours))
    points = rows.groupBy("feature", "value").agg(F.sum("n").alias("w")).select(
        "feature", F.col("value").alias("at"), F.lit(1).alias("turn"), "w", F.lit(None).cast(rows.schema[label].dataType).alias(label),
        F.lit(None).cast("double").alias("value"), F.lit(0).alias("sign"),
    )
    open_ = F.col("radius") > 0
    ends = F.array(
        F.struct((F.col("value") - F.col("radius")).alias("at"), F.when(open_, 2).otherwise(0).alias("turn"), F.lit(-1).alias("sign")),
        F.struct((F.col("value") + F.col("radius")).alias("at"), F.when(open_, 0).otherwise(2).alias("turn"), F.lit(1).alias("sign")),
    )
    asked = rows.select("feature", label, "value", F.inline(ends)).withColumn("w", F.lit(0).cast("long"))
    counted = running_totals(points.unionByName(asked), ["feature"], ["at", "turn"], ["w"]).where(F.col("sign") != 0)
    within = counted.groupBy("feature", label, "value").agg(F.sum(F.col("sign") * F.col("w_before")).alias("m"))
    parts = rows.join(within, ["feature", label, "value"])
    n = F.col("n").cast("double")
    whole = F.sum("n")
    mean = lambda c: F.sum(n * digamma(F.col(c))) / whole
    estimate = digamma(whole) + mean("k") - mean("n_class") - mean("m")
    scored = parts.groupBy("feature").agg(F.greatest(F.lit(0.0), estimate).alias("mutual_information"))
    ranked = scored.orderBy(F.desc("mutual_information"), "feature")
    return ranked if top is None else ranked.limit(top)
