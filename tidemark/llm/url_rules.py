"""URL rules by a sort-merge range join: reversed-host keys, intervals, a sweep with a stack of rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.llm.common import checkpointed
from tidemark.session import small_frame

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Just above "." in byte order: closes the interval of a host and its subdomains.
CLOSES = "/"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from last to first, each closed by a dot, so that subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def boundaries(rules: Sequence[Rule]) -> list[tuple[str, list[dict]]]:
    """Where the set of active rules changes, in key order, and the stack active from there."""
    hosts: dict[str, list[Rule]] = {}
    for rule in dict.fromkeys(rules):
        hosts.setdefault(_key(rule.host), []).append(rule)
    events, stack = [], []

    def active() -> list[dict]:
        return [
            {"host_size": len(r.host), "path_size": len(r.path), "rule": r.host + r.path, "path": r.path, "verdict": r.verdict}
            for _, own in stack for r in own
        ]

    def close_before(key: str | None) -> None:
        while stack and (key is None or not key.startswith(stack[-1][0])):
            end = stack.pop()[0][:-1] + CLOSES
            events.append((end, active()))

    for key in sorted(hosts, key=str.encode):
        close_before(key)
        stack.append((key, hosts[key]))
        events.append((key, active()))
    close_before(None)
    # Where one interval ends and another begins at the same key, the later event holds.
    return list(dict(events).items())


def judged_urls(
    pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_column: str = "page_id", url: str = "url"
) -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; among
    those that fit, the longest host and then the longest path wins. ``rules`` is a list held
    by the driver. Urls and the ends of the rules' intervals are sorted together into ranges
    (a host with many urls is cut over several, by path and id); in each range one sweep
    carries the stack of active rules to the urls, and the stack that a range begins with is
    that of the last boundary before it.

    A null url or one without ``://`` has an empty host and path and gets ``default``. Repeated
    rows are judged each, a null id stays null, an empty table gives no rows, and other
    columns are not read.
    """
    spark = pages.sparkSession
    rule_type = "array<struct<host_size:int,path_size:int,rule:string,path:string,verdict:string>>"
    urls = pages.select(F.col(id_column).alias("_id"), url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"))
    urls = urls.select("*", host_key(F.col("_host")).alias("_key"), F.lit(1).alias("_turn"), F.lit(None).cast(rule_type).alias("_stack"))
    ends = small_frame(spark, boundaries(rules), T.StructType.fromDDL(f"_key string, _stack {rule_type}"))
    ends = ends.select(F.lit(None).cast("long").alias("_id"), F.lit("").alias("_host"), F.lit("").alias("_path"), "_key", F.lit(0).alias("_turn"), "_stack")
    order = ["_key", "_turn", "_path", "_id"]
    ranged = checkpointed(urls.unionByName(ends).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # One row per range: what is active where the range ends, if a boundary lies in it.
    lasts = ranged.groupBy("_range").agg(F.max_by("_stack", F.when(F.col("_turn") == 0, F.col("_key"))).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    sweep = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("_active", F.last("_stack", ignorenulls=True).over(sweep)).where("_turn = 1")
    swept = swept.join(F.broadcast(carried), "_range").withColumn("_active", F.coalesce("_active", "_carried"))
    fitting = F.filter("_active", lambda r: F.col("_path").startswith(r["path"]))
    best = F.array_max(fitting)
    return swept.select(
        F.col("_id").alias(id_column), F.col("_host").alias("host"), F.col("_path").alias("path"),
        best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )
