"""Ranks, running totals and quantiles against single-machine results, also under skew."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import plan, rows
from tidemark.operators.joins import KeyNotUnique, assert_unique, heavy_keys, many_to_one, one_to_one
from tidemark.operators import selection
from tidemark.operators.ranks import hash_rank
from tidemark.operators.scan import running_totals
from tidemark.operators.selection import exact_quantiles, quantile_columns

RNG = random.Random(7)


def skewed_values(n=3000):
    """A third of one value, a third packed into a tiny range, a third spread out."""
    return [0.25] * (n // 3) + [0.3 + RNG.random() * 1e-9 for _ in range(n // 3)] + [RNG.gauss(0, 100) for _ in range(n // 3)]


def test_hash_rank_equals_a_global_sort(spark):
    ids = list(range(500))
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in ids], "id long, g string")
    found = {r["id"]: r["position"] for r in rows(hash_rank(df, ["g"], 5, ["id"], digits=1), "id")}
    for g in ("a", "b"):
        members = [i for i in ids if ("a" if i % 3 else "b") == g]
        ordered = sorted(members, key=lambda i: hashlib.md5(f"5-{i}".encode()).hexdigest())
        assert [found[i] for i in ordered] == list(range(1, len(members) + 1))
    everything = hash_rank(df, [], 5, ["id"], digits=1)
    assert sorted(r["position"] for r in everything.collect()) == list(range(1, 501))


def test_hash_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(i, None if i < 5 else "x") for i in range(10)], "id long, g string")
    assert hash_rank(df, ["g"], 1, ["id"]).count() == 10


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(spark, by):
    values = sorted(set(skewed_values()))
    data = [(v, 1 + i % 4, "p" if i % 5 else "q") for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "v double, w long, g string").repartition(7)
    out = rows(running_totals(df, by, "v", ["w"]), "v")
    assert len(out) == len(values)
    seen = {}
    for r in out:
        key = r["g"] if by else "all"
        assert r["w_before"] == seen.get(key, 0)
        seen[key] = seen.get(key, 0) + r["w"]
    assert all(r["w_all"] == seen[r["g"] if by else "all"] for r in out)


@pytest.fixture
def small_tasks(spark):
    """Tiny tables stay in as many tasks as large ones would have."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_running_totals_of_one_hot_group(spark, without_broadcast, small_tasks):
    """A group with all rows takes part in every task; nothing is exchanged by the group alone but one row a range."""
    df = spark.range(20_000).select(F.lit("only").alias("model"), (F.col("id") * 7919 % 20_000).alias("v"), F.lit(1).alias("w")).repartition(3)
    totals = running_totals(df, ["model"], "v", ["w"])
    text = plan(totals)
    assert "hashpartitioning(__range" in text and "SinglePartition" not in text
    assert totals.where("w_before <> v or w_all <> 20000").count() == 0
    assert totals.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_running_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 4)], "g string, v int, w int")
    out = {(r["g"], r["v"]): (r["w_before"], r["w_all"]) for r in running_totals(df, ["g"], "v", ["w"]).collect()}
    assert out == {(None, 1): (0, 5), (None, 2): (2, 5), ("a", 1): (0, 4)}


@pytest.fixture(params=[4096, 2])
def sorted_rows(request, monkeypatch):
    """Buckets are divided on down to so few rows."""
    monkeypatch.setattr(selection, "SORTED_ROWS", request.param)


def test_exact_quantiles(spark, sorted_rows):
    groups = {"hot": skewed_values(), "one": [3.5], "two": [1.0, 2.0], "same": [4.0] * 50, "none": [None]}
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("two", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    asked = [0.0, 0.01, 0.3333, 0.5, 0.77, 0.99, 1.0]
    out = {(r["g"], r["probability"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", asked).collect()}
    for g in ("hot", "one", "two", "same"):
        for q in asked:
            assert out[(g, q)] == pytest.approx(np.quantile(groups[g], q), rel=1e-12), (g, q)
    assert len(out) == 4 * len(asked)


def test_discrete_quantiles(spark):
    groups = {"hot": skewed_values(), "one": [3.5], "two": [1.0, 2.0], "five": [5.0, 1.0, 4.0, 2.0, 3.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    asked = [0.0, 0.2, 0.5, 0.9, 1.0]
    out = {(r["g"], r["probability"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", asked, interpolate=False).collect()}
    for g, values in groups.items():
        for q in asked:
            assert out[(g, q)] == sorted(values)[max(0, math.ceil(q * len(values)) - 1)], (g, q)


def test_exact_quantiles_of_a_whole_table(spark):
    values = skewed_values()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = {r["probability"]: r["quantile"] for r in exact_quantiles(df, [], "v", [0.1, 0.9]).collect()}
    assert out[0.1] == pytest.approx(np.quantile(values, 0.1)) and out[0.9] == pytest.approx(np.quantile(values, 0.9))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_a_hot_key(spark, without_broadcast, how):
    data = [(1, i) for i in range(4000)] + [(2 + i % 3000, i) for i in range(6000)] + [(99999, -2)]
    data += [(None, -i) for i in range(3000)]
    many = spark.createDataFrame(data, "k long, x long")
    one = spark.createDataFrame([(i, i * 10) for i in range(1, 3500)], "k long, y long")
    assert {1, None} <= set(heavy_keys(many, "k"))
    joined = many_to_one(many, one, "k", how)
    text = plan(joined)
    assert "Union" in text and "BroadcastHashJoin" in text and "SortMergeJoin" in text
    lookup = {i: i * 10 for i in range(1, 3500)}
    expected = sorted((k or 0, x, lookup.get(k) or 0) for k, x in data if how == "left" or k in lookup)
    assert sorted((r["k"] or 0, r["x"], r["y"] or 0) for r in joined.collect()) == expected


def test_join_without_a_hot_key_scans_once(spark, without_broadcast):
    many = spark.range(20000).select((F.col("id") % 10000).alias("k"), F.col("id").alias("x"))
    one = spark.range(10000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    joined = many_to_one(many, one, "k", share=1 / 100)
    assert joined.count() == 20000


def test_small_side_is_left_to_spark(spark):
    many, one = spark.range(100).toDF("k"), spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("y"))
    assert "BroadcastHashJoin" in plan(many_to_one(many, one, "k"))
    with pytest.raises(ValueError):
        many_to_one(many, one, "k", "outer")


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    b = spark.createDataFrame([(1, 0.5), (1, 0.6)], "k long, b double")
    with pytest.raises(KeyNotUnique):
        one_to_one(a, b, "k")
    assert one_to_one(a, b.limit(1), "k").count() == 1
    assert_unique(a, ["k"])


def test_selection_of_extreme_values(spark, without_broadcast, sorted_rows):
    groups = {
        "wide": [1e308, -1e308, 5e-324, 0.0, -0.0, -5e-324, 1e-300, math.inf, -math.inf, math.inf, 1.0, 1.0 + 2**-52],
        "nan": [1.0, math.nan, 2.0, math.nan], None: [3.0, 4.0, 5.0], "hot": [math.inf] * 500 + [0.1 + k * 2**-50 for k in range(1500)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    asked = [k / 12 for k in range(13)]
    found = {r["g"]: r["quantiles"] for r in quantile_columns(df, ["g"], "v", asked, interpolate=False).collect()}
    for g, values in groups.items():
        ordered = sorted(values, key=lambda v: (v != v, v if v == v else 0.0))
        assert repr([v + 0.0 for v in found[g]]) == repr([ordered[max(0, math.ceil(q * len(values)) - 1)] + 0.0 for q in asked]), g


def test_selection_of_many_distinct_values(spark):
    """600,000 different values, a third of them in one group: exact where a sketch is not."""
    key = F.when(F.col("id") < 200_000, 0).otherwise(1 + F.col("id") % 5)
    df = spark.range(600_000).select(key.alias("k"), ((F.col("id") * 7919 % 600_011) / 3.0).alias("v"))
    found = {r["k"]: r["quantiles"][0] for r in quantile_columns(df, ["k"], "v", [0.5], interpolate=False).collect()}
    expected = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("l")).select(
        "k", F.expr("l[CAST(ceil(size(l) / 2) AS INT) - 1]").alias("m")).collect()}
    sketched = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile_approx("v", 0.5, 10_000).alias("m")).collect()}
    assert found == expected and sketched != expected


def test_exact_quantiles_with_infinities(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (math.inf,)], "v double")
    out = {r["probability"]: r["quantile"] for r in exact_quantiles(df, [], "v", [0.0, 0.25, 0.9]).collect()}
    assert out == {0.0: 1.0, 0.25: math.inf, 0.9: math.inf}
