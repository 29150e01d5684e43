"""Event, interval, label and product queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from catalogue import standins as s
from catalogue.common import Entry, present, r, rs, table
from catalogue.standins import FEATURES, SETTINGS, secs, sql_flags, sql_measures, with_tables
from tidemark.functions.clock import epoch_seconds, hours_between, window_index
from tidemark.functions.indicators import (
    age_years,
    category_indicator,
    label_or_event,
    with_missing_flags,
)
from tidemark.functions.measures import bounded_means, feature_measures, trends
from tidemark.operators.align import (
    clip_audit,
    clip_to_interval,
    into_windows,
    on_entity_clock,
    within_first_hours,
)
from tidemark.operators.codes import normalise_events
from tidemark.operators.prep import model_frame
from tidemark.operators.reference import eligible_start, envelope, first_interval, first_start, stay_summary
from tidemark.operators.reports import class_balance, cohort_flow, group_summary, missing_fraction, source_audit
from tidemark.operators.totals import entity_measures
from tidemark.plans import products as p
from tidemark.plans.etl import run_product
from tidemark.plans.report import as_long, cohort_report
from tidemark.plans.validation import ValidationSettings
from tidemark.session import shared_folder
from tidemark.sources.runlog import read_log
from tidemark.sources.tables import typed_projection

SPINE = ["age", "gender_male"]
STAY = ["icu_los_mean", "icu_los_total", "icu_stay_count"]
LAB = ["lab_value_mean", "lab_value_std", "lab_value_count", "lab_abnormal_count"]
LAB_WIDE = [*LAB, "lab_value_min", "lab_value_max", "lab_value_median"]
KEYS = "hadm_id, subject_id, mortality_label"
ENTRIES: dict[str, Entry] = {}


def add(name: str, build, sql: str | None) -> None:
    ENTRIES[name] = Entry(build, sql)


def mapped(spark, d, apply_ranges: bool = True) -> DataFrame:
    return normalise_events(s.chart_events(spark, d), s.BOOK, apply_ranges=apply_ranges)


def placed(spark, d) -> DataFrame:
    return on_entity_clock(mapped(spark, d), envelope(s.stays(spark, d)))


def measured(names: list[str]) -> list[str]:
    return [f"{f}_{m}" for f in FEATURES for m in names]


# ---- products ------------------------------------------------------------------------------------

COMPACT_FLAGS = [*STAY, *[f"{f}_mean" for f in FEATURES], *LAB]
COMPACT_VALUES = [*SPINE, *STAY, *measured(["mean", "count"]), *LAB]
COMPACT_MATRIX = f"""
vitals AS (SELECT hadm_id, {sql_measures(['mean', 'count'])} FROM mapped GROUP BY hadm_id),
matrix AS (
  SELECT * FROM spine LEFT JOIN stay_summary USING (hadm_id) LEFT JOIN vitals USING (hadm_id)
  LEFT JOIN lab_summary USING (hadm_id))"""
add(
    "compact_features",
    lambda spark, d: present(p.compact_features(s.cohort(spark, d), SETTINGS)),
    with_tables(f"SELECT {KEYS}, {rs(COMPACT_VALUES)}, {sql_flags(COMPACT_FLAGS)} FROM matrix", COMPACT_MATRIX),
)

ALL_MEASURES = ["mean", "count", "min", "max", "std", "median"]
TIMED = [f"{f}_{m}" for f in FEATURES for m in ("mean_24h", "mean_48h", "trend")]
WIDE_CLINICAL = [*STAY, *measured(ALL_MEASURES), *TIMED, *LAB_WIDE]
SQL_TIMED = ", ".join(
    f"avg(CASE WHEN feature = '{f}' AND elapsed_seconds <= {h} * 3600 THEN value END) AS {f}_mean_{h}h"
    for f in FEATURES for h in (24, 48)
)
SQL_TREND = ", ".join(
    f"arg_max(CASE WHEN feature = '{f}' THEN value END, CASE WHEN feature = '{f}' THEN (charttime, event_id) END) - "
    f"arg_min(CASE WHEN feature = '{f}' THEN value END, CASE WHEN feature = '{f}' THEN (charttime, event_id) END) AS {f}_trend"
    for f in FEATURES
)
WIDE_MATRIX = f"""
base AS (SELECT hadm_id, {sql_measures(ALL_MEASURES)} FROM mapped GROUP BY hadm_id),
timed AS (SELECT hadm_id, {SQL_TIMED}, {SQL_TREND} FROM placed GROUP BY hadm_id),
matrix AS (
  SELECT * FROM spine LEFT JOIN stay_summary USING (hadm_id) LEFT JOIN base USING (hadm_id)
  LEFT JOIN timed USING (hadm_id) LEFT JOIN lab_summary USING (hadm_id))"""
add(
    "wide_features",
    lambda spark, d: present(p.wide_features(s.cohort(spark, d), SETTINGS)),
    with_tables(f"SELECT {KEYS}, {rs([*SPINE, *WIDE_CLINICAL])}, {sql_flags(WIDE_CLINICAL)} FROM matrix", WIDE_MATRIX),
)

WINDOW_MEASURES = ["mean", "min", "max", "std", "count"]
WINDOWS = f"""
windows AS (
  SELECT hadm_id, window_idx, {sql_measures(WINDOW_MEASURES)}
  FROM (SELECT *, CAST(floor(elapsed_seconds / CAST(21600 AS DOUBLE)) AS INTEGER) AS window_idx
        FROM placed WHERE charttime BETWEEN ref_start AND ref_end) w
  WHERE window_idx >= 0 GROUP BY hadm_id, window_idx)"""
add(
    "window_features",
    lambda spark, d: present(p.window_features(s.cohort(spark, d), SETTINGS)),
    with_tables(
        f"SELECT hadm_id, window_idx, subject_id, mortality_label, {rs([*measured(WINDOW_MEASURES), *SPINE, *STAY, *LAB])} "
        "FROM windows JOIN spine USING (hadm_id) LEFT JOIN stay_summary USING (hadm_id) LEFT JOIN lab_summary USING (hadm_id)",
        WINDOWS,
    ),
)

EARLY_MEASURES = ["mean", "min", "max", "std", "median", "count"]
EARLY_CLINICAL = [*measured(EARLY_MEASURES), "lab_value_count", "lab_abnormal_count"]


def sql_early(column: str) -> str:
    gap = f"{secs(column)} - {secs('ref_start')}"
    return f"{gap} >= 0 AND {gap} < 48 * 3600"


EARLY_LABS = f"""
early_labs AS (
  SELECT l.hadm_id, CAST(count(valuenum) AS DOUBLE) AS lab_value_count,
         CAST(sum(CASE WHEN trim(flag) <> '' AND lower(flag) <> 'normal' THEN 1 ELSE 0 END) AS DOUBLE) AS lab_abnormal_count
  FROM labs l JOIN eligible e ON l.hadm_id = e.hadm_id
  WHERE valuenum IS NOT NULL AND {sql_early('charttime')} GROUP BY l.hadm_id)"""
EARLY = f"""
early AS (
  SELECT m.hadm_id, {sql_measures(EARLY_MEASURES)}
  FROM mapped m JOIN eligible e ON m.hadm_id = e.hadm_id
  WHERE {sql_early('charttime')} GROUP BY m.hadm_id), {EARLY_LABS},
matrix AS (
  SELECT spine.*, early.* EXCLUDE (hadm_id), early_labs.* EXCLUDE (hadm_id)
  FROM eligible JOIN spine ON eligible.hadm_id = spine.hadm_id
  LEFT JOIN early ON early.hadm_id = spine.hadm_id LEFT JOIN early_labs ON early_labs.hadm_id = spine.hadm_id)"""
add(
    "early_window_features",
    lambda spark, d: present(p.early_window_features(s.cohort(spark, d), SETTINGS)),
    with_tables(f"SELECT {KEYS}, {rs([*SPINE, *EARLY_CLINICAL])}, {sql_flags(EARLY_CLINICAL)} FROM matrix", EARLY),
)
add(
    "entity_spine",
    lambda spark, d: present(p.entity_spine(s.cohort(spark, d), SETTINGS)),
    with_tables(f"SELECT {KEYS}, {rs(SPINE)} FROM spine"),
)

# ---- events ----------------------------------------------------------------------------------------

add(
    "code_mapping",
    lambda spark, d: present(
        mapped(spark, d, False).groupBy("feature").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")), 3
    ),
    with_tables(f"SELECT feature, count(*) AS n_events, {r('sum(value)', 'total', 3)} FROM converted WHERE feature IS NOT NULL GROUP BY feature"),
)
add(
    "unit_conversion",
    lambda spark, d: present(mapped(spark, d, False).select("event_id", "feature", "value")),
    with_tables(f"SELECT event_id, feature, {r('value', 'value')} FROM converted WHERE feature IS NOT NULL"),
)
add(
    "range_filter",
    lambda spark, d: present(mapped(spark, d).select("event_id", "hadm_id", "feature", "value")),
    with_tables(f"SELECT event_id, hadm_id, feature, {r('value', 'value')} FROM mapped"),
)
add(
    "interval_clip",
    lambda spark, d: _clipped(spark, d).select("event_id", "hadm_id", "elapsed_seconds"),
    with_tables(
        f"SELECT event_id, m.hadm_id, {secs('charttime')} - {secs('ref_start')} AS elapsed_seconds "
        "FROM mapped m JOIN first_stay f ON m.hadm_id = f.hadm_id WHERE charttime BETWEEN ref_start AND ref_end"
    ),
)


def _on_first(spark, d) -> DataFrame:
    first = first_interval(s.stays(spark, d)).select("hadm_id", "ref_start", "ref_end")
    return on_entity_clock(mapped(spark, d), first)


def _clipped(spark, d) -> DataFrame:
    return clip_to_interval(_on_first(spark, d))


add(
    "interval_clip_audit",
    lambda spark, d: present(clip_audit(_on_first(spark, d))),
    with_tables(
        "SELECT candidate_rows, kept_rows, candidate_rows - kept_rows AS clipped_rows, "
        f"{r('100.0 * (candidate_rows - kept_rows) / candidate_rows', 'clipped_percent')} FROM ("
        "SELECT count(*) AS candidate_rows, CAST(sum(CASE WHEN charttime BETWEEN ref_start AND ref_end THEN 1 ELSE 0 END) AS BIGINT) AS kept_rows "
        "FROM mapped m JOIN first_stay f ON m.hadm_id = f.hadm_id) a"
    ),
)
add(
    "early_window_filter",
    lambda spark, d: within_first_hours(
        on_entity_clock(mapped(spark, d), eligible_start(s.stays(spark, d), 72)), 48
    ).select("event_id", "hadm_id", "feature", "elapsed_seconds"),
    with_tables(
        f"SELECT event_id, m.hadm_id, feature, {secs('charttime')} - {secs('ref_start')} AS elapsed_seconds "
        f"FROM mapped m JOIN eligible e ON m.hadm_id = e.hadm_id WHERE {sql_early('charttime')}"
    ),
)


def _elapsed_hours(spark, d) -> DataFrame:
    joined = on_entity_clock(mapped(spark, d), first_start(s.stays(spark, d)))
    hours = hours_between(epoch_seconds(joined, "charttime"), epoch_seconds(joined, "ref_start"))
    return joined.select("event_id", hours.alias("elapsed_hours"))


add(
    "elapsed_hours",
    lambda spark, d: present(_elapsed_hours(spark, d)),
    with_tables(f"SELECT event_id, {r('elapsed_seconds / CAST(3600 AS DOUBLE)', 'elapsed_hours')} FROM placed"),
)


def _order_windows(spark, d) -> DataFrame:
    """Lines on the clock of their order, thirty-day windows; lines before the order drop out."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    start = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ref_start"))
    clock = on_entity_clock(lines, start, "l_orderkey", "l_shipdate")
    indexed = into_windows(clock, 720)
    return indexed.groupBy("window_idx").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"))


add(
    "window_index",
    _order_windows,
    f"""SELECT window_idx, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM (
      SELECT l_orderkey, CAST(floor(({secs('l_shipdate')} - {secs('o_orderdate')}) / CAST(2592000 AS DOUBLE)) AS INTEGER) AS window_idx
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) w WHERE window_idx >= 0 GROUP BY window_idx""",
)
add(
    "first_interval",
    lambda spark, d: _in_seconds(first_interval(s.stays(spark, d))).select("hadm_id", "icustay_id", "start_s", "end_s"),
    with_tables(f"SELECT hadm_id, icustay_id, {secs('ref_start')} AS start_s, {secs('ref_end')} AS end_s FROM first_stay"),
)


def _in_seconds(df: DataFrame) -> DataFrame:
    columns = {"start_s": epoch_seconds(df, "ref_start")}
    if "ref_end" in df.columns:
        columns["end_s"] = epoch_seconds(df, "ref_end")
    return df.withColumns(columns)


add(
    "interval_envelope",
    lambda spark, d: _in_seconds(envelope(s.stays(spark, d))).select("hadm_id", "start_s", "end_s"),
    with_tables(f"SELECT hadm_id, {secs('ref_start')} AS start_s, {secs('ref_end')} AS end_s FROM envelope"),
)
add(
    "reference_start",
    lambda spark, d: _in_seconds(first_start(s.stays(spark, d))).select("hadm_id", "start_s"),
    with_tables(f"SELECT hadm_id, {secs('ref_start')} AS start_s FROM envelope"),
)
add(
    "min_duration_cohort",
    lambda spark, d: _in_seconds(eligible_start(s.stays(spark, d), 72)).select("hadm_id", "start_s"),
    with_tables(f"SELECT hadm_id, {secs('ref_start')} AS start_s FROM eligible"),
)
add(
    "stay_summary",
    lambda spark, d: present(stay_summary(s.stays(spark, d))),
    with_tables(f"SELECT hadm_id, {rs(STAY)} FROM stay_summary"),
)

# ---- measures --------------------------------------------------------------------------------------


def _measures(names: list[str]):
    return lambda spark, d: present(mapped(spark, d).groupBy("hadm_id").agg(*feature_measures(FEATURES, names)))


def _measures_sql(names: list[str]) -> str:
    return with_tables(f"SELECT hadm_id, {rs(measured(names))} FROM (SELECT hadm_id, {sql_measures(names)} FROM mapped GROUP BY hadm_id) v")


for _name, _set in {
    "cond_mean_count": ["mean", "count"],
    "cond_min_max_std": ["min", "max", "std"],
}.items():
    add(_name, _measures(_set), _measures_sql(_set))

add(
    "cond_median",
    lambda spark, d: present(entity_measures(mapped(spark, d), "hadm_id", FEATURES, ["median"])),
    _measures_sql(["median"]),
)


def _bounded(spark, d) -> DataFrame:
    clock = placed(spark, d)
    hours = F.col("elapsed_seconds") / F.lit(3600.0)
    return clock.groupBy("hadm_id").agg(*bounded_means(FEATURES, [24, 48], hours))


add(
    "bounded_means",
    lambda spark, d: present(_bounded(spark, d)),
    with_tables(
        f"SELECT hadm_id, {rs([f'{f}_mean_{h}h' for f in FEATURES for h in (24, 48)])} "
        f"FROM (SELECT hadm_id, {SQL_TIMED} FROM placed GROUP BY hadm_id) v"
    ),
)
add(
    "first_last_trend",
    lambda spark, d: present(
        placed(spark, d).groupBy("hadm_id").agg(*trends(FEATURES, [F.col("charttime"), F.col("event_id")]))
    ),
    with_tables(
        f"SELECT hadm_id, {rs([f'{f}_trend' for f in FEATURES])} FROM (SELECT hadm_id, {SQL_TREND} FROM placed GROUP BY hadm_id) v"
    ),
)
add(
    "lab_summary",
    lambda spark, d: present(p.lab_summary(s.labs(spark, d), SETTINGS)),
    with_tables(f"SELECT hadm_id, {rs(LAB)} FROM lab_summary"),
)
add(
    "lab_wide_summary",
    lambda spark, d: present(p.lab_summary(s.labs(spark, d), SETTINGS, wide=True)),
    with_tables(f"SELECT hadm_id, {rs(LAB_WIDE)} FROM lab_summary"),
)
add(
    "lab_early_utilisation",
    lambda spark, d: present(
        p.lab_utilisation(
            within_first_hours(on_entity_clock(s.labs(spark, d), eligible_start(s.stays(spark, d), 72)), 48), SETTINGS
        )
    ),
    with_tables(f"SELECT hadm_id, {rs(['lab_value_count', 'lab_abnormal_count'])} FROM early_labs", EARLY_LABS),
)

# ---- labels, indicators, flags ---------------------------------------------------------------------


def _ages(spark, d) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", age_years("l_shipdate", "o_orderdate", 2.0, 2.5).alias("age")
    )


_AGE = f"({s.months_between('l_shipdate', 'o_orderdate')}) / 12"
add(
    "age_capped",
    lambda spark, d: present(_ages(spark, d)),
    f"SELECT l_orderkey, l_linenumber, l_partkey, {r(f'CASE WHEN {_AGE} > 2.0 THEN 2.5 ELSE {_AGE} END', 'age')} "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
add(
    "label_coalesce",
    lambda spark, d: s.admissions(spark, d).select(
        "hadm_id", label_or_event("hospital_expire_flag", "deathtime").alias("mortality_label")
    ),
    with_tables("SELECT hadm_id, mortality_label FROM spine"),
)
add(
    "category_flag",
    lambda spark, d: table(spark, d, "customer").select(
        "c_custkey", category_indicator("c_mktsegment", "building").alias("is_building")
    ),
    "SELECT c_custkey, CASE WHEN upper(c_mktsegment) = 'BUILDING' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_building FROM customer",
)


def _joined_matrix(spark, d) -> DataFrame:
    tables = s.cohort(spark, d)
    return p.entity_spine(tables, SETTINGS).select("hadm_id", "age").join(
        stay_summary(tables.stays), "hadm_id", "left"
    )


_MISSING = "SELECT hadm_id, {0} FROM spine LEFT JOIN stay_summary USING (hadm_id)"
add(
    "missing_flags_fixed",
    lambda spark, d: with_missing_flags(_joined_matrix(spark, d), ["icu_los_mean", "icu_stay_count"]).select(
        "hadm_id", "icu_los_mean_missing", "icu_stay_count_missing"
    ),
    with_tables(_MISSING.format(sql_flags(["icu_los_mean", "icu_stay_count"]))),
)
add(
    "missing_flags_all",
    lambda spark, d: with_missing_flags(_joined_matrix(spark, d), keys=["hadm_id"]).select(
        "hadm_id", *[f"{c}_missing" for c in ("age", *STAY)]
    ),
    with_tables(_MISSING.format(sql_flags(["age", *STAY]))),
)

# ---- sources ----------------------------------------------------------------------------------------

TEXT_COLUMNS = [
    ("row_id", "bigint", "row_id"), ("hadm_id", "bigint", "hadm_id"), ("itemid", "int", "itemid"),
    ("charttime", "timestamp", "charttime"), ("valuenum", "double", "valuenum"),
]


def _as_text(spark, d) -> DataFrame:
    """Lines as raw text with the defects of hand-made files: blanks, words, decimal commas."""
    text = F.col("l_quantity").cast("int").cast("string")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("row_id"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_suppkey").cast("string")).alias("hadm_id"),
        F.when(F.col("l_linestatus") == "F", "x").otherwise(F.col("l_partkey").cast("string")).alias("itemid"),
        F.when(F.col("l_linenumber") == 1, "zzz").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("charttime"),
        F.when(F.col("l_linenumber") == 2, F.concat(F.lit(">"), text))
        .when(F.col("l_linenumber") == 3, F.concat(text, F.lit(",5")))
        .otherwise(F.concat(text, F.lit(".5"))).alias("valuenum"),
    )


def _typed(spark, d) -> DataFrame:
    typed = typed_projection(_as_text(spark, d), TEXT_COLUMNS, ["hadm_id"])
    return typed.withColumn("charttime", epoch_seconds(typed, "charttime"))


add(
    "typed_projection",
    _typed,
    f"""SELECT CAST(row_id AS BIGINT) AS row_id, TRY_CAST(hadm_id AS BIGINT) AS hadm_id, TRY_CAST(itemid AS INTEGER) AS itemid,
      {secs('TRY_CAST(charttime AS TIMESTAMP)')} AS charttime, TRY_CAST(valuenum AS DOUBLE) AS valuenum FROM (
      SELECT CAST(l_orderkey AS VARCHAR) AS row_id,
        CASE WHEN l_returnflag = 'R' THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS hadm_id,
        CASE WHEN l_linestatus = 'F' THEN 'x' ELSE CAST(l_partkey AS VARCHAR) END AS itemid,
        CASE WHEN l_linenumber = 1 THEN 'zzz' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS charttime,
        CASE WHEN l_linenumber = 2 THEN '>' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
             WHEN l_linenumber = 3 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',5'
             ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5' END AS valuenum
      FROM lineitem) t WHERE TRY_CAST(hadm_id AS BIGINT) IS NOT NULL""",
)
AUDITED = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]
add(
    "source_audit",
    lambda spark, d: source_audit({name: table(spark, d, name) for name in AUDITED}),
    " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {name}" for name in AUDITED),
)

# ---- reports ----------------------------------------------------------------------------------------

add(
    "class_balance",
    lambda spark, d: present(class_balance(p.entity_spine(s.cohort(spark, d), SETTINGS), "mortality_label")),
    with_tables(f"SELECT mortality_label, {r('count(*) / CAST((SELECT count(*) FROM spine) AS DOUBLE)', 'proportion')} FROM spine GROUP BY mortality_label"),
)


def _missing(spark, d) -> DataFrame:
    frame, names = model_frame(p.compact_features(s.cohort(spark, d), SETTINGS))
    return missing_fraction(frame, names)


add(
    "missing_fraction",
    lambda spark, d: present(_missing(spark, d)),
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {r(f'avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)', 'missing_fraction')} FROM matrix"
            for c in COMPACT_VALUES
        )
        + " UNION ALL "
        + " UNION ALL ".join(f"SELECT '{c}_missing' AS feature, CAST(0 AS DOUBLE) AS missing_fraction" for c in COMPACT_FLAGS),
        COMPACT_MATRIX,
    ),
)


def _flow(spark, d) -> DataFrame:
    tables = s.cohort(spark, d)
    spine = p.entity_spine(tables, SETTINGS)
    eligible = eligible_start(tables.stays, 72).join(spine, "hadm_id")
    return cohort_flow(
        [("all_admissions", spine), ("eligible", eligible), ("eligible_with_age", eligible.where(F.col("age").isNotNull()))],
        "subject_id",
    )


_FLOW = "SELECT '{0}' AS stage, count(*) AS n_rows, count(DISTINCT subject_id) AS n_patients FROM {1}"
add(
    "cohort_flow",
    _flow,
    with_tables(
        " UNION ALL ".join([
            _FLOW.format("all_admissions", "spine"),
            _FLOW.format("eligible", "eligible JOIN spine USING (hadm_id)"),
            _FLOW.format("eligible_with_age", "eligible JOIN spine USING (hadm_id) WHERE age IS NOT NULL"),
        ])
    ),
)
_SUMMED = ["l_quantity", "l_extendedprice"]
add(
    "group_summary",
    lambda spark, d: present(
        group_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], _SUMMED, None), 4
    ),
    "SELECT l_returnflag, l_linestatus, "
    + ", ".join(
        r(f"{f}({v})", f"{v}_{n}", 4)
        for v in _SUMMED
        for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )
    + " FROM lineitem GROUP BY l_returnflag, l_linestatus",
)

# ---- compositions ----------------------------------------------------------------------------------


def _run_record(spark, d) -> DataFrame:
    """One product written with its record; the counts as the log has them, and those of the clip audit."""
    folder = f"{shared_folder(spark)}/product-{uuid.uuid4().hex}"
    record = run_product(
        spark, d, folder, "timeseries", "registered", "one", f"{folder}/log", "parquet", settings=SETTINGS, formats=["parquet"],
        tables=s.cohort(spark, d),
    )
    logged = read_log(spark, f"{folder}/log")
    audit = [f"clip_{k}" for k in ("candidate_rows", "kept_rows")]
    added = F.create_map(*[F.lit(x) for k in audit for x in (k, int(record["clip_audit"][k.removeprefix("clip_")]))])
    every = F.map_concat("raw_counts", F.create_map(F.lit("product"), F.col("feature_rows")), added)
    return logged.select(F.explode(every).alias("counted", "n_rows"))


add(
    "product_run_record",
    _run_record,
    with_tables(
        " UNION ALL ".join(f"SELECT '{n}' AS counted, count(*) AS n_rows FROM {t}" for n, t in {
            "admissions": "admissions", "patients": "patients", "stays": "stays", "events": "events", "labs": "labs",
            "product": "windows JOIN spine USING (hadm_id)", "clip_candidate_rows": "placed",
            "clip_kept_rows": "placed WHERE charttime BETWEEN ref_start AND ref_end",
        }.items()),
        WINDOWS,
    ),
)
REPORT_SETTINGS = ValidationSettings([], ids=["hadm_id"])


def _cohort_report(spark, d) -> DataFrame:
    matrix = p.compact_features(s.cohort(spark, d), SETTINGS)
    tables = cohort_report(matrix, REPORT_SETTINGS, repeats=3, folds=5)
    return present(as_long({k: tables[k] for k in ("cohort_flow", "class_balance", "missingness", "cv_diagnostics")}))


_FOLDED = """labelled AS (SELECT * FROM matrix WHERE mortality_label IS NOT NULL),
folded AS (SELECT l.*, fold FROM labelled l JOIN (
  SELECT subject_id, (row_number() OVER (ORDER BY n_pos, n_rows, md5(concat_ws('-', '42', subject_id)), subject_id) - 1) % 5 AS fold
  FROM (SELECT subject_id, sum(mortality_label) AS n_pos, count(*) AS n_rows FROM labelled GROUP BY subject_id) g) f USING (subject_id)),
sides AS (SELECT k.fold, count(DISTINCT CASE WHEN f.fold <> k.fold THEN subject_id END) AS n_groups_train,
  count(DISTINCT CASE WHEN f.fold = k.fold THEN subject_id END) AS n_groups_test,
  count(CASE WHEN f.fold <> k.fold THEN 1 END) AS n_rows_train, count(CASE WHEN f.fold = k.fold THEN 1 END) AS n_rows_test,
  avg(CASE WHEN f.fold <> k.fold THEN mortality_label END) AS positive_rate_train,
  avg(CASE WHEN f.fold = k.fold THEN mortality_label END) AS positive_rate_test
  FROM folded f, (SELECT DISTINCT fold FROM folded) k GROUP BY k.fold)"""
_REPORT_FEATURES = [c for c in COMPACT_VALUES if c not in ("hadm_id", "subject_id", "mortality_label")]
_CELLS = [
    *[("cohort_flow", f"'{stage}'", m, e, t) for stage, t in (("all_rows", "matrix"), ("labelled_rows", "labelled"))
      for m, e in (("n_rows", "count(*)"), ("n_patients", "count(DISTINCT subject_id)"))],
    ("class_balance", "CAST(mortality_label AS VARCHAR)", "proportion", "count(*) / CAST((SELECT count(*) FROM labelled) AS DOUBLE)",
     "labelled GROUP BY mortality_label"),
    *[("missingness", f"'{c}'", "missing_fraction", f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", "labelled") for c in _REPORT_FEATURES],
    *[("missingness", f"'{c}_missing'", "missing_fraction", "0", "(SELECT 1) one") for c in COMPACT_FLAGS],
    *[("cv_diagnostics", "CAST(fold AS VARCHAR)", m, m, "sides") for m in (
        "n_groups_train", "n_groups_test", "n_rows_train", "n_rows_test", "positive_rate_train", "positive_rate_test")],
]
add(
    "cohort_report",
    _cohort_report,
    with_tables(
        " UNION ALL ".join(f"SELECT '{a}' AS section, {b} AS item, '{m}' AS measure, {r(e, 'value')} FROM {t}" for a, b, m, e, t in _CELLS),
        COMPACT_MATRIX + ", " + _FOLDED,
    ),
)
