"""Reproducible splits: stratified by label, or by whole groups with balanced label rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.operators.joins import many_to_one, measured_size
from tidemark.operators.ranks import hash_rank
from tidemark.session import BROADCAST_ROWS, materialise, small_frame


class GroupLeak(ValueError):
    """A group has rows on both sides of a split."""


def stratified_holdout(
    df: DataFrame, label: str, ids: Sequence[str], seed: int, test_size: float = 0.2
) -> DataFrame:
    """Add ``is_test``: the first ``round(n * test_size)`` rows of each label in seeded order."""
    ranked = hash_rank(df, [label], seed, ids, "__position")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(label, "__label")
    joined = ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("__label")))
    taken = F.round(F.col("__n") * F.lit(float(test_size)))
    return joined.withColumn("is_test", F.col("__position") <= taken).drop("__position", "__n", "__label")


def stratified_folds(
    df: DataFrame, label: str, ids: Sequence[str], seed: int, folds: int = 5, name: str = "fold"
) -> DataFrame:
    """Add ``fold`` in 0..folds-1, dealt round-robin inside each label in seeded order."""
    ranked = hash_rank(df, [label], seed, ids, "__position")
    return ranked.withColumn(name, ((F.col("__position") - 1) % F.lit(folds)).cast("int")).drop("__position")


def group_sizes(df: DataFrame, group: str, label: str) -> DataFrame:
    """Positives and rows per group, computed once: everything after it reads this table only."""
    return materialise(df.groupBy(group).agg(
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("__pos"),
        F.count(F.lit(1)).alias("__rows"),
    ))


def _deal(
    groups: DataFrame, group: str, seed: int | Column, folds: int, name: str, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., group, fold): groups ranked by (positives, rows, seeded hash), dealt round-robin.

    The rank is global but the groups are never sorted as a whole. Groups are counted per
    stratum of equal (positives, rows); a running count over the strata gives each stratum
    its offset, and hash buckets give the rank inside it. n rows have fewer than sqrt(2n)
    different group sizes, so both running counts stay small.
    """
    by = list(by)
    strata = groups.groupBy(*by, "__pos", "__rows").agg(F.count(F.lit(1)).alias("__groups"))
    earlier = (Window.unboundedPreceding, -1)
    by_size = Window.partitionBy(*by, "__pos").orderBy("__rows").rowsBetween(*earlier)
    by_pos = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__pos").rowsBetween(*earlier)
    lower = strata.groupBy(*by, "__pos").agg(F.sum("__groups").alias("__groups")).select(
        *by, "__pos", F.coalesce(F.sum("__groups").over(by_pos), F.lit(0)).alias("__lower")
    )
    offsets = strata.join(lower, [*by, "__pos"]).select(
        *by, "__pos", "__rows", (F.col("__lower") + F.coalesce(F.sum("__groups").over(by_size), F.lit(0))).alias("__offset")
    )
    ranked = hash_rank(groups, [*by, "__pos", "__rows"], seed, [group], "__position")
    place = F.col("__offset") + F.col("__position") - F.lit(1)
    return ranked.join(offsets, [*by, "__pos", "__rows"]).select(*by, group, (place % F.lit(folds)).cast("int").alias(name))


def group_folds(
    df: DataFrame, group: str, label: str, seed: int, folds: int = 5, name: str = "fold"
) -> DataFrame:
    """(group, fold): whole groups spread over folds with even sizes and label rates."""
    return _deal(group_sizes(df, group, label), group, seed, folds, name)


def with_group_folds(
    df: DataFrame, group: str, label: str, seed: int, folds: int = 5, name: str = "fold"
) -> DataFrame:
    """Rows with the fold of their group."""
    groups = group_sizes(df, group, label)
    dealt = _deal(groups, group, seed, folds, name)
    return many_to_one(df, dealt, group, measured_bytes=measured_size(groups, group))


def group_holdout(
    df: DataFrame, group: str, label: str, seed: int, test_size: float = 0.2
) -> DataFrame:
    """Add ``is_test``: the first of ``round(1 / test_size)`` group folds (at least two)."""
    folds = max(2, round(1.0 / test_size))
    dealt = with_group_folds(df, group, label, seed, folds, "__fold")
    return dealt.withColumn("is_test", F.col("__fold") == 0).drop("__fold")


# Groups of a stratum, in multiples of the folds, that are placed one by one before the rest is dealt in turn.
PLACED_ROUNDS = 4


class FoldBalance:
    """Where groups of equal (positives, rows) go, one stratum after the other.

    A group goes to the fold in which it adds least to the variance, over the folds, of their shares of either class (ties:
    fewest rows, then the lowest fold). The sums are of whole numbers, so ties are exact.
    """

    def __init__(self, folds: int, positives: int, negatives: int):
        self.folds = folds
        self.weights = (max(negatives, 1) ** 2, max(positives, 1) ** 2)
        self.pos, self.neg = [0] * folds, [0] * folds

    def _place(self, pos: int, neg: int) -> int:
        cost = [p * pos * self.weights[0] + n * neg * self.weights[1] for p, n in zip(self.pos, self.neg)]
        fold = min(range(self.folds), key=lambda f: (cost[f], self.pos[f] + self.neg[f], f))
        self.pos[fold] += pos
        self.neg[fold] += neg
        return fold

    def stratum(self, pos: int, rows: int, groups: int) -> tuple[list[int], int, list[int]]:
        """(folds of the first groups, how many are then dealt in turn, folds of the last groups)."""
        first = [self._place(pos, rows - pos) for _ in range(min(groups, PLACED_ROUNDS * self.folds))]
        rounds = (groups - len(first)) // self.folds
        for f in range(self.folds):
            self.pos[f] += rounds * pos
            self.neg[f] += rounds * (rows - pos)
        rest = groups - len(first) - rounds * self.folds
        return first, rounds * self.folds, [self._place(pos, rows - pos) for _ in range(rest)]


def balanced_group_folds(
    df: DataFrame, group: str, label: str, seed: int, folds: int = 5, name: str = "fold"
) -> DataFrame:
    """(group, fold): whole groups, placed greedily so that folds get even shares of both classes.

    Groups are compressed to strata of equal (positives, rows), which are taken from the most one-sided on. Inside a stratum
    groups follow a seeded order; the first of them and the last are placed one by one, all others
    are dealt in turn, so the work on the driver grows with the strata. n rows have at most (3n)^(2/3) / 2 strata.
    Rows without a group are left out.
    """
    groups = group_sizes(df.where(F.col(group).isNotNull()), group, label)
    strata = groups.groupBy("__pos", "__rows").agg(F.count(F.lit(1)).alias("__groups")).collect()
    whole = sum(r["__pos"] * r["__groups"] for r in strata)
    balance = FoldBalance(folds, whole, sum(r["__rows"] * r["__groups"] for r in strata) - whole)
    plan = []
    for r in sorted(strata, key=lambda r: (-abs(2 * r["__pos"] - r["__rows"]), -r["__rows"], -r["__pos"])):
        plan.append((r["__pos"], r["__rows"], *balance.stratum(r["__pos"], r["__rows"], r["__groups"])))
    schema = "__pos long, __rows long, __first array<int>, __dealt long, __last array<int>"
    placed = small_frame(df.sparkSession, plan, T._parse_datatype_string(schema))
    ranked = hash_rank(groups, ["__pos", "__rows"], seed, [group], "__position")
    at, n_first = F.col("__position") - F.lit(1), F.size("__first")
    fold = (
        F.when(at < n_first, F.get("__first", at.cast("int")))
        .when(at < n_first + F.col("__dealt"), ((at - n_first) % F.lit(folds)).cast("int"))
        .otherwise(F.get("__last", (at - n_first - F.col("__dealt")).cast("int")))
    )
    known = F.broadcast(placed) if len(plan) <= BROADCAST_ROWS else placed
    return ranked.join(known, ["__pos", "__rows"]).select(group, fold.alias(name))


def repeated_group_holdouts(
    df: DataFrame, group: str, label: str, seeds: Sequence[int], test_size: float = 0.2, name: str = "seed"
) -> DataFrame:
    """Every row once per seed, with ``is_test`` as ``group_holdout`` gives it for that seed.

    All seeds are dealt in one plan, over the groups; a group then brings its rows the list of the seeds it is
    held out in, so rows meet their groups in one join, and only then are repeated.
    """
    folds = max(2, round(1.0 / test_size))
    groups = group_sizes(df, group, label)
    every = groups.withColumn(name, F.explode(F.lit([int(s) for s in seeds])))
    dealt = _deal(every, group, F.col(name), folds, "__fold", [name])
    held = dealt.groupBy(group).agg(F.collect_set(F.when(F.col("__fold") == 0, F.col(name))).alias("__held"))
    joined = many_to_one(df, held, group, measured_bytes=measured_size(groups, group, 64 + 8 * len(seeds)))
    repeated = joined.withColumn(name, F.explode(F.lit([int(s) for s in seeds])))
    return repeated.select(*df.columns, name, F.array_contains("__held", F.col(name)).alias("is_test"))


def nested_group_folds(
    df: DataFrame,
    group: str,
    label: str,
    seed: int,
    outer: str = "is_test",
    folds: int = 5,
    name: str = "inner_fold",
) -> DataFrame:
    """Inner group folds of the training rows; test rows are left out."""
    return with_group_folds(df.where(~F.col(outer)), group, label, seed, folds, name)


def leaking_groups(df: DataFrame, group: str, is_test) -> DataFrame:
    """Groups with rows on both sides of a split."""
    test = is_test if not isinstance(is_test, str) else F.col(is_test)
    sides = df.groupBy(group).agg(F.max(test.cast("int")).alias("__hi"), F.min(test.cast("int")).alias("__lo"))
    return sides.where(F.col("__hi") != F.col("__lo")).select(group)


def assert_groups_disjoint(df: DataFrame, group: str, is_test="is_test") -> None:
    """Raise if a group spans the split."""
    shown = [row[0] for row in leaking_groups(df, group, is_test).limit(5).collect()]
    if shown:
        raise GroupLeak(f"{group} spans train and test, for example {shown}")


def split_diagnostics(
    df: DataFrame, group: str, label: str, is_test: str = "is_test", by: Sequence[str] = ()
) -> DataFrame:
    """Groups, rows and positive rate on each side of a split, per ``by``."""
    test = F.col(is_test)
    y = F.col(label).cast("double")
    per_group = df.groupBy(*by, group).agg(
        F.count_if(test).alias("__test"),
        F.count_if(~test).alias("__train"),
        F.sum(F.when(test, y)).alias("__test_pos"),
        F.sum(F.when(~test, y)).alias("__train_pos"),
    )
    rows_train, rows_test = F.sum("__train"), F.sum("__test")
    return per_group.groupBy(*by).agg(
        F.count_if(F.col("__train") > 0).alias("n_groups_train"),
        F.count_if(F.col("__test") > 0).alias("n_groups_test"),
        rows_train.alias("n_rows_train"),
        rows_test.alias("n_rows_test"),
        F.try_divide(F.sum("__train_pos"), rows_train).alias("positive_rate_train"),
        F.try_divide(F.sum("__test_pos"), rows_test).alias("positive_rate_test"),
    )


def fold_diagnostics(df: DataFrame, group: str, label: str, fold: str = "fold") -> DataFrame:
    """Split diagnostics of every fold taken as the test side in turn.

    Groups do not span folds, so the training side of a fold is the total minus the fold.
    """
    y = F.col(label).cast("double")
    per_group = df.groupBy(fold, group).agg(F.count(F.lit(1)).alias("__rows"), F.sum(y).alias("__pos"))
    per_fold = per_group.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n_groups_test"),
        F.sum("__rows").alias("n_rows_test"),
        F.sum("__pos").alias("__pos"),
    )
    whole = Window.partitionBy(F.lit(0))
    rows_train = F.sum("n_rows_test").over(whole) - F.col("n_rows_test")
    pos_train = F.sum("__pos").over(whole) - F.col("__pos")
    return per_fold.select(
        fold,
        (F.sum("n_groups_test").over(whole) - F.col("n_groups_test")).alias("n_groups_train"),
        "n_groups_test",
        rows_train.alias("n_rows_train"),
        "n_rows_test",
        F.try_divide(pos_train, rows_train).alias("positive_rate_train"),
        F.try_divide(F.col("__pos"), F.col("n_rows_test")).alias("positive_rate_test"),
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight ``n / (n_classes * n_label)``."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(F.lit(0))
    n, classes = F.sum("__n").over(whole), F.count(F.lit(1)).over(whole)
    return sizes.select(label, "__n", n.alias("__total"), classes.alias("__classes")).select(
        label, (F.col("__total") / (F.col("__classes") * F.col("__n"))).alias("weight")
    )


def with_balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Rows with the weight of their class (one row per class, so broadcast)."""
    weights = balanced_weights(df, label).withColumnRenamed("weight", name)
    return df.join(F.broadcast(weights), label)
