"""Physical plans: what is scanned, shuffled and split."""

import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="benchmark tables absent")


def test_measures_take_one_shuffle_and_prune_the_scan(spark):
    from catalogue import QUERIES

    text = plan(QUERIES["cond_min_max_std"](spark, DATA))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Exchange") - text.count("BroadcastExchange") == 1
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "PushedFilters: [In(event_type" in scan and "IsNotNull(value)" in scan
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in scan


def test_trend_needs_no_window_sort(spark):
    from catalogue import QUERIES

    assert "Window" not in plan(QUERIES["wide_features"](spark, DATA))


def test_no_product_uses_a_cross_join(spark):
    from catalogue import QUERIES

    for name in ("compact_features", "wide_features", "window_features", "early_window_features"):
        text = plan(QUERIES[name](spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_hot_windows_are_split_by_adaptive_execution(spark, without_broadcast):
    """The last join of the window product: one entity with most of the windows."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        events = spark.range(60000).select(
            F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 500).alias("hadm_id"),
            (F.col("id") / 2).cast("int").alias("window_idx"),
        ).repartition(8)
        windows = events.groupBy("hadm_id", "window_idx").agg(F.count("*").alias("n"))
        context = spark.range(500).select(F.col("id").alias("hadm_id"), F.lit(1.0).alias("age"))
        joined = windows.join(context, "hadm_id")
        rows = joined.collect()
        assert "skew=true" in plan(joined)
        assert sum(r["n"] for r in rows) == 60000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
