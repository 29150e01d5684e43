"""Rows that are fitted on are dealt into partitions by their number."""

import numpy as np
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import boosting
from tidemark.operators.boosting import fit_boosted


def test_rows_in_one_partition_are_dealt_and_all_stay(spark, monkeypatch):
    monkeypatch.setattr(session, "FIT_ROWS", 100)
    one = spark.range(1000).coalesce(1).withColumn("x", F.col("id") % 7)
    dealt = session.spread(one)
    assert dealt.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, one.collect()))
    assert session.spread(dealt).rdd.getNumPartitions() == 10
    assert session.spread(spark.range(0)).count() == 0


def test_boosted_trees_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    rows = spark.range(600).selectExpr("id", "double(id % 17) AS a", "double(id % 29) AS b", "int(id % 17 + id % 5 > 9) AS y").coalesce(1)
    monkeypatch.setattr(session, "FIT_ROWS", 50)
    scores = [
        {r["id"]: r["p"] for r in fit_boosted(train, ["a", "b"], "y", rounds=7).score(rows, ["id"]).collect()}
        for train in (rows, session.spread(rows))
    ]
    assert max(abs(scores[0][i] - scores[1][i]) for i in scores[0]) < 1e-9


def test_a_pass_over_the_blocks_has_fewer_tasks_than_dealt_partitions_and_all_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "FIT_ROWS", 10)
    train = session.spread(spark.range(640).selectExpr("int(id % 2) AS y", "double(id) AS a").coalesce(1))
    assert train.rdd.getNumPartitions() == 64
    blocks = boosting._blocks(train, ["a"], "y", [np.arange(0.0, 640.0, 10.0)], 0.0, {0: 1.0, 1: 1.0})
    assert blocks.rdd.getNumPartitions() == max(8, min(64, spark.sparkContext.defaultParallelism))
    sums = boosting._node_sums(blocks, [], boosting.Tree(), [0], 1, 65)[0]
    assert sums[..., 2].sum() == 640 and sums[0, 1, 2] == 10
