"""Splits: exact sizes, disjoint groups, balanced labels, reproducibility."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators import splits as sp


@pytest.fixture(scope="module")
def frame(spark):
    """Groups of 1, 2 and 10 rows and one group that holds a third of everything."""
    data, i = [], 0
    for g in range(300):
        for _ in range(300 * 3 // 2 if g == 0 else (1, 2, 10, 1)[g % 4]):
            data.append((i, g, int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 10 < 3))
            i += 1
    return spark.createDataFrame([(i, g, int(y)) for i, g, y in data], "id long, g long, y int").cache()


def test_stratified_holdout_sizes(frame):
    out = sp.stratified_holdout(frame, "y", ["id"], 3, 0.2)
    for r in rows(out.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")), "y"):
        assert r["t"] == round(r["n"] * 0.2)
    again = sp.stratified_holdout(frame.repartition(9), "y", ["id"], 3, 0.2)
    assert {r["id"] for r in out.where("is_test").collect()} == {r["id"] for r in again.where("is_test").collect()}


def test_stratified_folds_are_even(frame):
    out = sp.stratified_folds(frame, "y", ["id"], 3, 4)
    for y in (0, 1):
        sizes = [r["count"] for r in out.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_group_folds_equal_a_global_ranking(frame):
    sizes = {}
    for r in frame.collect():
        n = sizes.setdefault(r["g"], [0, 0])
        n[0] += r["y"]
        n[1] += 1
    order = sorted(sizes, key=lambda g: (*sizes[g], hashlib.md5(f"11-{g}".encode()).hexdigest()))
    expected = {g: i % 5 for i, g in enumerate(order)}
    assert {r["g"]: r["fold"] for r in sp.group_folds(frame, "g", "y", 11).collect()} == expected


def test_group_folds_through_a_shuffle_join(frame, spark, without_broadcast):
    out = sp.with_group_folds(frame, "g", "y", 11)
    assert out.count() == frame.count()
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_group_holdout_is_disjoint_and_complete(frame):
    out = sp.group_holdout(frame, "g", "y", 5, 0.25)
    sp.assert_groups_disjoint(out, "g")
    assert out.count() == frame.count()
    inner = sp.nested_group_folds(out, "g", "y", 5, folds=3)
    assert inner.count() == out.where(~F.col("is_test")).count()
    assert {r["inner_fold"] for r in inner.select("inner_fold").distinct().collect()} == {0, 1, 2}


def test_a_leaking_split_raises(frame):
    leaking = frame.withColumn("is_test", F.col("id") % 2 == 0)
    with pytest.raises(sp.GroupLeak):
        sp.assert_groups_disjoint(leaking, "g")


def test_diagnostics_add_up(frame):
    dealt = sp.with_group_folds(frame, "g", "y", 1)
    total, groups = frame.count(), frame.select("g").distinct().count()
    out = rows(sp.fold_diagnostics(dealt, "g", "y"), "fold")
    assert sum(r["n_rows_test"] for r in out) == total
    for r in out:
        assert r["n_rows_train"] + r["n_rows_test"] == total and r["n_groups_train"] + r["n_groups_test"] == groups
        one = sp.split_diagnostics(dealt.withColumn("is_test", F.col("fold") == r["fold"]), "g", "y").first()
        assert one["positive_rate_train"] == pytest.approx(r["positive_rate_train"])
        assert one["n_groups_test"] == r["n_groups_test"]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r["y"]: r["weight"] for r in sp.balanced_weights(df, "y").collect()} == {0: 8 / 12, 1: 2.0}
    assert sp.with_balanced_weights(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(8.0)


def test_repeated_holdouts_equal_single_ones(spark, without_broadcast):
    data = [(i, i % 37 if i % 11 else None, int(i % 5 == 0)) for i in range(600)] + [(1000 + i, 5, 1) for i in range(300)]
    df = spark.createDataFrame(data, "id long, g long, y int")
    every = sp.repeated_group_holdouts(df, "g", "y", [3, 4, 5])
    assert every.columns == ["id", "g", "y", "seed", "is_test"]
    for seed in (3, 4, 5):
        one = {(r["id"], r["is_test"]) for r in sp.group_holdout(df, "g", "y", seed).collect()}
        assert {(r["id"], r["is_test"]) for r in every.where(F.col("seed") == seed).collect()} == one
        assert len(one) == sum(1 for _, g, _ in data if g is not None)


def spread(rows, fold_of, folds):
    """Variance over the folds of their shares of either class, added up."""
    shares = {y: [0] * folds for y in (0, 1)}
    for g, y in rows:
        shares[y][fold_of[g]] += 1
    total = 0.0
    for counts in shares.values():
        whole = sum(counts) or 1
        total += sum((c / whole - 1 / folds) ** 2 for c in counts) / folds
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_balanced_folds_spread_classes_better_than_dealing_by_rank(spark, seed):
    """A few large one-sided groups, one of them a tenth of all rows, and many small ones."""
    data = [(0, int(i % 10 == 0)) for i in range(600)]
    for g in range(1, 900):
        size = (1, 2, 2, 7, 40)[g % 5] if g % 60 else 150
        data += [(g, int((i * 7 + g) % 11 < (8 if g % 3 == 0 else 1))) for i in range(size)]
    df = spark.createDataFrame(data + [(None, 1)], "g long, y int")
    greedy = {r["g"]: r["fold"] for r in sp.balanced_group_folds(df, "g", "y", seed).collect()}
    ranked = {r["g"]: r["fold"] for r in sp.group_folds(df.where("g IS NOT NULL"), "g", "y", seed).collect()}
    assert set(greedy) == set(ranked) == {g for g, _ in data} and set(greedy.values()) == set(range(5))
    assert spread(data, greedy, 5) <= spread(data, ranked, 5)
    assert greedy == {r["g"]: r["fold"] for r in sp.balanced_group_folds(df.repartition(7), "g", "y", seed).collect()}


def test_a_stratum_is_placed_as_its_groups_one_by_one():
    for groups in (3, 20, 21, 24, 25, 57):
        balance = sp.FoldBalance(5, 300, 700)
        balance.pos, balance.neg = [9, 0, 4, 4, 1], [30, 10, 12, 12, 50]
        one = sp.FoldBalance(5, 300, 700)
        one.pos, one.neg = list(balance.pos), list(balance.neg)
        first, dealt, last = balance.stratum(2, 5, groups)
        assert len(first) + dealt + len(last) == groups and dealt % 5 == 0 and len(last) < 5
        assert first == [one._place(2, 3) for _ in first]
        assert sum(balance.pos) == 18 + 2 * groups and sum(balance.neg) == 114 + 3 * groups
