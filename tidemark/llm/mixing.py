"""Mixing sources to target weights: repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import checkpointed, running_starts, small_or_not, text_or_empty, unfolded

WORD = "[^\\x20\\x09-\\x0D]+"
# Hexadecimal digits of a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


def word_count(text: str = "text") -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def draw(seed: int, id_column: str, text: str = "text") -> Column:
    """A number in [0, 1) from seed, id and text: equal in every run and any engine."""
    key = F.concat_ws(
        "-", F.lit(f"mix{seed}"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.md5(text_or_empty(text))
    )
    digits = F.substring(F.md5(key), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_targets(
    sized: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
) -> DataFrame:
    """One row per source: source, source_size, weight, target, rate.

    ``sized`` has the columns source and size. Sources in code-point order, null last,
    take the ``weights`` in turn and divide ``share`` times all sizes among them. A target
    above ``most`` times its source's size stops there and the excess is divided again by
    weight, until none is above. Sums are exact integers; each round of sharing is one
    aggregate over the sources, and only its two sums reach the driver. If every source
    stops, the rest of the share is not given out. A source of size 0 has rate 0.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = sources.withColumns({"_one": F.lit(1).cast("long"), "_null": F.col("source").isNull()})
    ranked = running_starts(sources, ["_null", "source"], "_one", "_rank")
    turn = (F.col("_rank") % F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn + 1)
    ranked = checkpointed(ranked.select("source", "source_size", weight.alias("weight")))

    wide = "decimal(38,0)"
    total, all_weights = ranked.agg(
        F.coalesce(F.sum(F.col("source_size").cast(wide)), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    # Everything in units of 1 / share.denominator, so that all sums are whole numbers.
    unit = share.denominator
    rest, left = int(total) * share.numerator, int(all_weights)
    cap = (F.col("source_size") * F.lit(most * unit)).cast(wide)
    stopped, fixed = F.lit(False), (0, 0)
    while left > 0:
        stopped = (F.col("weight").cast(wide) * F.lit(rest).cast(wide)) > (cap * F.lit(left).cast(wide))
        held, taken = ranked.where(stopped).agg(
            F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
        ).first()
        if (int(held), int(taken)) == fixed:
            break
        fixed = (int(held), int(taken))
        rest, left = int(total) * share.numerator - fixed[0], int(all_weights) - fixed[1]
    even = (F.lit(float(rest)) * F.col("weight").cast("double")) / F.lit(float(max(left, 1) * unit))
    target = F.when(stopped, F.col("source_size").cast("double") * F.lit(float(most))).otherwise(even)
    ranked = ranked.withColumn("target", target)
    return ranked.withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def _copies(seed: int, id_column: str) -> Column:
    whole = F.floor("_rate")
    return (whole + (draw(seed, id_column) < F.col("_rate") - whole).cast("long")).cast("long")


def _with_rates(docs: DataFrame, sized: DataFrame, join_on: str, **options) -> DataFrame:
    """``docs`` with _rate, _target and _source_size of each row's source."""
    targets = checkpointed(source_targets(sized, **options)).select(
        F.col("source").alias("_source"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("rate").alias("_rate"),
    )
    # Above the checked size the join shuffles, and adaptive execution splits hot sources.
    return docs.join(small_or_not(targets), F.col(join_on).eqNullSafe(F.col("_source")), "left").drop("_source")


def mix_plan(docs: DataFrame, seed: int = 42, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per document: id_column, source, size, source_size, target, copies, taken.

    ``taken`` is size times copies. A document is emitted floor(rate) times, and once more
    if its draw lies below the fraction of the rate; the draw depends on seed, id and text
    alone, so reruns agree and repeated rows share their draw.

    Nulls: a null text has size 0; a null source is a source of its own, ordered last; a
    null id draws as the word "null". An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col("source").alias("source"), F.col("text").alias("text"))
    rows = rows.withColumn("size", word_count())
    sized = rows.select("source", "size")
    planned = _with_rates(rows, sized, "source", **options).withColumn("copies", _copies(seed, "_id"))
    return planned.select(
        F.col("_id").alias(id_column), "source", "size",
        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = 42, id_column: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document's whole row, as often as ``mix_plan`` says."""
    own = docs.columns
    sized = docs.select(F.col("source").alias("source"), word_count().alias("size"))
    planned = _with_rates(docs, sized, "source", **options).withColumn("_copies", _copies(seed, id_column))
    return unfolded(planned, "_copies", "_copy").select(*own)
