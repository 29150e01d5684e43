"""The benchmark tables in the roles of the five clinical tables.

Entities are customers; the 'users' of the event stream are a subset of them, so most
entities have no events and every missing-value path is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.common import table
from tidemark.functions.clock import epoch_seconds
from tidemark.operators.codes import Code, CodeBook
from tidemark.plans.products import CohortTables, ProductSettings

FEATURES = ["engage", "spend", "fault"]
BOOK = CodeBook(
    codes=[
        Code("view", "engage"),
        Code("click", "engage"),
        Code("purchase", "spend"),
        Code("signup", "spend", offset=32.0, scale=5.0 / 9.0),
        Code("error", "fault"),
    ],
    ranges={"engage": (1.0, 200.0), "spend": (0.0, 150.0), "fault": (5.0, 120.0)},
)
SETTINGS = ProductSettings(
    book=BOOK, cap_above=28.5, cap_to=29.0, male="BUILDING", early_hours=48, early_min_hours=72,
    tie_columns=("event_id",),
)
BLOCK_SECONDS = 4 * 86400
START = "2024-01-01 00:00:00"


def chart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("hadm_id"),
        F.col("event_type").alias("itemid"),
        F.col("ts").alias("charttime"),
        F.col("value").alias("valuenum"),
        "event_id",
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entered = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("admittime"),
        F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 150), F.col("ts"))).alias("deathtime"),
    )
    flag = F.when(F.col("c_acctbal") > 5000, F.lit(None)).when(F.col("c_acctbal") < 0, 1).otherwise(0)
    joined = table(spark, sf_dir, "customer").join(entered, F.col("user_id") == F.col("c_custkey"), "left")
    return joined.select(
        F.col("c_custkey").alias("subject_id"),
        F.col("c_custkey").alias("hadm_id"),
        "admittime",
        "deathtime",
        flag.cast("int").alias("hospital_expire_flag"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("dob"))
    joined = table(spark, sf_dir, "customer").join(born, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("gender"), "dob")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    since = epoch_seconds(events, "ts") - F.unix_seconds(F.lit(START).cast("timestamp"))
    block = F.floor(since / F.lit(float(BLOCK_SECONDS))).cast("long")
    spans = events.groupBy("user_id", block.alias("block")).agg(
        F.min("ts").alias("intime"), F.max("ts").alias("outtime")
    )
    length = (epoch_seconds(spans, "outtime") - epoch_seconds(spans, "intime")) / F.lit(86400.0)
    return spans.select(
        F.col("user_id").alias("subject_id"),
        F.col("user_id").alias("hadm_id"),
        (F.col("user_id") * 1000 + F.col("block")).alias("icustay_id"),
        "intime",
        "outtime",
        length.alias("icu_los_days"),
    )


def labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"
    )
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date"))
    flag = F.when(F.col("l_returnflag") == "N", "NORMAL").when(F.col("l_returnflag") == "R", "abnormal").otherwise(" ")
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("hadm_id"),
        F.col("l_partkey").alias("itemid"),
        F.timestamp_add("SECOND", day * 1000, F.lit(START).cast("timestamp_ntz")).alias("charttime"),
        F.col("l_quantity").alias("valuenum"),
        flag.alias("flag"),
    )


def cohort(spark: SparkSession, sf_dir: str) -> CohortTables:
    return CohortTables(
        admissions(spark, sf_dir), patients(spark, sf_dir), stays(spark, sf_dir),
        chart_events(spark, sf_dir), labs(spark, sf_dir),
    )


# ---- the same tables in SQL -------------------------------------------------------------------


def secs(column: str) -> str:
    return f"CAST(floor(epoch({column})) AS BIGINT)"


def months_between(later: str, earlier: str) -> str:
    a, b = later, earlier
    months = f"((year({a}) - year({b})) * 12 + month({a}) - month({b}))"
    ends = f"(last_day(CAST({a} AS DATE)) = CAST({a} AS DATE) AND last_day(CAST({b} AS DATE)) = CAST({b} AS DATE))"
    clock = "(hour({0}) * 3600 + minute({0}) * 60 + CAST(floor(second({0})) AS BIGINT))"
    rest = f"((day({a}) - day({b})) * 86400 + {clock.format(a)} - {clock.format(b)})"
    return (
        f"CASE WHEN day({a}) = day({b}) OR {ends} THEN CAST({months} AS DOUBLE) "
        f"ELSE round({months} + {rest} / CAST(2678400 AS DOUBLE), 8) END"
    )


SQL_TABLES = f"""
per_user AS (
  SELECT user_id, min(ts) AS admittime,
         max(CASE WHEN event_type = 'error' AND value > 150 THEN ts END) AS deathtime
  FROM events GROUP BY user_id),
admissions AS (
  SELECT c_custkey AS subject_id, c_custkey AS hadm_id, admittime, deathtime,
         CASE WHEN c_acctbal > 5000 THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS hospital_expire_flag
  FROM customer LEFT JOIN per_user ON user_id = c_custkey),
patients AS (
  SELECT c_custkey AS subject_id, c_mktsegment AS gender, dob
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS dob FROM orders GROUP BY o_custkey) born
    ON o_custkey = c_custkey),
stays AS (
  SELECT user_id AS hadm_id, user_id * 1000 + block AS icustay_id, min(ts) AS intime, max(ts) AS outtime,
         ({secs('max(ts)')} - {secs('min(ts)')}) / CAST(86400 AS DOUBLE) AS icu_los_days
  FROM (SELECT user_id, ts,
               CAST(floor(({secs('ts')} - {secs("TIMESTAMP '" + START + "'")}) / CAST({BLOCK_SECONDS} AS DOUBLE)) AS BIGINT) AS block
        FROM events) e
  GROUP BY user_id, block),
labs AS (
  SELECT o_custkey AS hadm_id, l_quantity AS valuenum,
         TIMESTAMP '{START}' + to_seconds(CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 1000 AS BIGINT)) AS charttime,
         CASE l_returnflag WHEN 'N' THEN 'NORMAL' WHEN 'R' THEN 'abnormal' ELSE ' ' END AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
converted AS (
  SELECT user_id AS hadm_id, event_id, ts AS charttime,
         CASE WHEN event_type IN ('view', 'click') THEN 'engage'
              WHEN event_type IN ('purchase', 'signup') THEN 'spend'
              WHEN event_type = 'error' THEN 'fault' END AS feature,
         CASE WHEN event_type = 'signup' THEN (value - 32) * (CAST(5 AS DOUBLE) / 9) ELSE value END AS value
  FROM events WHERE value IS NOT NULL),
mapped AS (
  SELECT * FROM converted
  WHERE (feature = 'engage' AND value BETWEEN 1 AND 200)
     OR (feature = 'spend' AND value BETWEEN 0 AND 150)
     OR (feature = 'fault' AND value BETWEEN 5 AND 120)),
spine AS (
  SELECT a.hadm_id, a.subject_id,
         CAST(coalesce(hospital_expire_flag, CASE WHEN deathtime IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS mortality_label,
         CASE WHEN ({months_between('admittime', 'dob')}) / 12 > 28.5 THEN 29
              ELSE ({months_between('admittime', 'dob')}) / 12 END AS age,
         CASE WHEN upper(gender) = 'BUILDING' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS gender_male
  FROM admissions a LEFT JOIN patients p ON a.subject_id = p.subject_id),
stay_summary AS (
  SELECT hadm_id, avg(icu_los_days) AS icu_los_mean, sum(icu_los_days) AS icu_los_total,
         CAST(count(DISTINCT icustay_id) AS DOUBLE) AS icu_stay_count
  FROM stays GROUP BY hadm_id),
lab_summary AS (
  SELECT hadm_id, avg(valuenum) AS lab_value_mean, stddev_samp(valuenum) AS lab_value_std,
         CAST(count(valuenum) AS DOUBLE) AS lab_value_count,
         CAST(sum(CASE WHEN trim(flag) <> '' AND lower(flag) <> 'normal' THEN 1 ELSE 0 END) AS DOUBLE) AS lab_abnormal_count,
         min(valuenum) AS lab_value_min, max(valuenum) AS lab_value_max,
         quantile_disc(valuenum, 0.5) AS lab_value_median
  FROM labs WHERE valuenum IS NOT NULL GROUP BY hadm_id),
envelope AS (
  SELECT hadm_id, min(intime) AS ref_start, max(outtime) AS ref_end FROM stays GROUP BY hadm_id),
first_stay AS (
  SELECT hadm_id, icustay_id, intime AS ref_start, outtime AS ref_end
  FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY intime, icustay_id) AS rn
        FROM stays WHERE intime IS NOT NULL AND outtime IS NOT NULL) s
  WHERE rn = 1),
eligible AS (
  SELECT hadm_id, ref_start FROM first_stay WHERE {secs('ref_end')} - {secs('ref_start')} >= 72 * 3600),
placed AS (
  SELECT m.*, e.ref_start, e.ref_end, {secs('m.charttime')} - {secs('e.ref_start')} AS elapsed_seconds
  FROM mapped m JOIN envelope e ON m.hadm_id = e.hadm_id)
"""


def with_tables(body: str, extra: str = "") -> str:
    """SQL text with the stand-in tables (and ``extra`` table expressions) in front."""
    return f"WITH {SQL_TABLES}{', ' + extra if extra else ''} {body}"


SQL_MEASURES = {
    "mean": "avg({0})",
    "count": "CAST(count({0}) AS DOUBLE)",
    "min": "min({0})",
    "max": "max({0})",
    "std": "stddev_samp({0})",
    "median": "quantile_disc({0}, 0.5)",
}


def sql_measures(measures: list[str], features: list[str] = FEATURES) -> str:
    return ", ".join(
        SQL_MEASURES[m].format(f"CASE WHEN feature = '{f}' THEN value END") + f" AS {f}_{m}"
        for f in features
        for m in measures
    )


def sql_flags(names: list[str]) -> str:
    return ", ".join(
        f"CASE WHEN {n} IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {n}_missing" for n in names
    )
