"""Run-analytics, telemetry and model queries.

Orders aggregated to status x priority x month cells play the run table: a cell is one run
of a workload (status) in a scenario (priority) and a block (month), its time the mean price.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from catalogue import standins as s
from catalogue.common import Entry, present, r, rs, table
from catalogue.evaluation import sql_hash
from tidemark.functions.clock import epoch_seconds
from tidemark.functions.tdist import critical_value, two_sided_p
from tidemark.operators import experiments as ex
from tidemark.operators.models import fit_boosted, fit_forest, fit_logistic
from tidemark.operators.prep import Preprocessor, model_frame
from tidemark.operators.reports import group_summary, mean_std_text, top_rows
from tidemark.operators.splits import group_holdout
from tidemark.operators.telemetry import TASK_TOTALS, resource_alignment, resource_summary, telemetry_rollup
from tidemark.plans import products as p
from tidemark.plans.analysis import validation_analysis, with_telemetry
from tidemark.plans import validation as v
from tidemark.session import materialise, shared_folder
from tidemark.sources.incremental import scan_new
from tidemark.sources.runlog import repair_numbers

SEED = 20
CONTROL = "3-MEDIUM"
ARMS = ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"]
SCENARIOS = [CONTROL, *ARMS]
ENTRIES: dict[str, Entry] = {}


def add(name: str, build, sql: str | None) -> None:
    ENTRIES[name] = Entry(build, sql)


def run_table(spark, d) -> DataFrame:
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    cells = table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("workload"), F.col("o_orderpriority").alias("scenario"), month.cast("int").alias("block")
    ).agg(
        (F.avg("o_totalprice") / 1000.0).alias("total_seconds"),
        (F.min("o_totalprice") / 1000.0).alias("extract_seconds"),
        (F.max("o_totalprice") / 1000.0).alias("load_seconds"),
        F.count(F.lit(1)).alias("feature_rows"),
    )
    return cells.withColumns({
        "run_id": F.concat_ws("_", "workload", "scenario", "block"),
        "status": F.when(F.col("feature_rows") >= 5, F.lit("ok")).otherwise(F.lit("failed")),
        "input_format": F.when(F.col("extract_seconds") < 400, F.lit("parquet")).otherwise(F.lit("csv")),
    })


RUNS = """runs AS (SELECT *, concat_ws('_', workload, scenario, block) AS run_id,
    CASE WHEN feature_rows >= 5 THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN extract_seconds < 400 THEN 'parquet' ELSE 'csv' END AS input_format FROM (
  SELECT o_orderstatus AS workload, o_orderpriority AS scenario,
         CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS block,
         avg(o_totalprice) / 1000 AS total_seconds, min(o_totalprice) / 1000 AS extract_seconds,
         max(o_totalprice) / 1000 AS load_seconds, count(*) AS feature_rows
  FROM orders GROUP BY ALL) c)"""
PIVOT = RUNS + ", pivoted AS (SELECT workload, block, " + ", ".join(
    f"max(CASE WHEN scenario = '{x}' THEN total_seconds END) AS \"{x}\"" for x in SCENARIOS
) + " FROM runs GROUP BY workload, block)"


def sql_p(t: str, df: str) -> str:
    """Two-sided p by the finite trigonometric series for whole degrees of freedom."""
    cos = f"sqrt({df} / ({df} + ({t}) * ({t})))"
    sin = f"(abs({t}) / sqrt({df} + ({t}) * ({t})))"
    angle = f"atan(abs({t}) / sqrt(CAST({df} AS DOUBLE)))"

    def series(count: str, factor: str, power: str) -> str:
        term = (
            f"coalesce(list_aggregate(list_transform(range(1, k + 1), lambda j: {factor}), 'product'), 1) "
            f"* pow({cos}, {power})"
        )
        return f"list_sum(list_transform(range(0, {count}), lambda k: {term}))"

    even = f"{sin} * {series(f'CAST({df} // 2 AS BIGINT)', '(2 * j - 1) / CAST(2 * j AS DOUBLE)', '2 * k')}"
    odd = (
        f"2 / pi() * ({angle} + {sin} * coalesce("
        f"{series(f'CAST(({df} - 1) // 2 AS BIGINT)', '2 * j / CAST(2 * j + 1 AS DOUBLE)', '2 * k + 1')}, 0))"
    )
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def sql_pairs(pairs: list[tuple[str, str]]) -> str:
    long = " UNION ALL ".join(
        f"SELECT workload, '{a} - {c}' AS comparison, \"{a}\" AS arm, \"{c}\" AS control FROM pivoted "
        f"WHERE \"{a}\" IS NOT NULL AND \"{c}\" IS NOT NULL"
        for a, c in pairs
    )
    return f"""{PIVOT}, pairs AS ({long}),
    stats AS (SELECT workload, comparison, count(*) AS n_blocks, avg(arm) AS arm_mean, stddev_samp(arm) AS arm_std,
        avg(control) AS control_mean, stddev_samp(control) AS control_std, avg(arm - control) AS mean_difference,
        stddev_samp(arm - control) / sqrt(CAST(count(*) AS DOUBLE)) AS se, avg(ln(arm / control)) AS log_mean,
        stddev_samp(ln(arm / control)) / sqrt(CAST(count(*) AS DOUBLE)) AS log_se FROM pairs GROUP BY workload, comparison),
    tested AS (SELECT *, mean_difference / nullif(se, 0) AS paired_t FROM stats),
    valued AS (SELECT *, {sql_p('paired_t', '(n_blocks - 1)')} AS p_raw FROM tested)"""


# Critical values by bisection, one recursion per distinct degrees of freedom.
CRITICAL = f"""levels AS (SELECT DISTINCT n_blocks - 1 AS df FROM stats),
    halving AS (
      SELECT df, CAST(-20 AS DOUBLE) AS low, CAST(40 AS DOUBLE) AS high, 0 AS step FROM levels
      UNION ALL
      SELECT df, CASE WHEN p > 0.05 THEN mid ELSE low END, CASE WHEN p > 0.05 THEN high ELSE mid END, step + 1
      FROM (SELECT df, low, high, step, (low + high) / 2 AS mid, {sql_p('pow(2, (low + high) / 2)', 'df')} AS p FROM halving) h
      WHERE step < 60),
    critical AS (SELECT df, pow(2, (low + high) / 2) AS t_crit FROM halving WHERE step = 60)"""
BOUNDS = """bounded AS (SELECT v.*, mean_difference - t_crit * se AS difference_ci_low, mean_difference + t_crit * se AS difference_ci_high,
      exp(log_mean) AS geometric_ratio, exp(log_mean - t_crit * log_se) AS ratio_ci_low, exp(log_mean + t_crit * log_se) AS ratio_ci_high
    FROM valued v LEFT JOIN critical ON df = n_blocks - 1)"""
PAIRED = [
    "arm_mean", "arm_std", "control_mean", "control_std", "mean_difference", "difference_ci_low",
    "difference_ci_high", "geometric_ratio", "ratio_ci_low", "ratio_ci_high", "paired_t", "p_raw",
]
HOLM = """adjusted AS (SELECT *, least(CAST(1 AS DOUBLE), max(scaled) OVER (PARTITION BY workload ORDER BY p_raw, comparison ROWS UNBOUNDED PRECEDING)) AS p_holm
    FROM (SELECT *, (count(*) OVER (PARTITION BY workload) - row_number() OVER (PARTITION BY workload ORDER BY p_raw, comparison) + 1) * p_raw AS scaled FROM {0}) h)"""
PAIRS = [(a, CONTROL) for a in ARMS]

# ---- runs -----------------------------------------------------------------------------------------

add(
    "block_pivot",
    lambda spark, d: present(ex.block_pivot(run_table(spark, d), SCENARIOS), 4),
    f"WITH {PIVOT} SELECT workload, block, " + ", ".join(r(f'"{x}"', f'"{x}"', 4) for x in SCENARIOS) + " FROM pivoted",
)
add(
    "paired_contrast",
    lambda spark, d: present(ex.paired_contrasts(run_table(spark, d), ARMS, CONTROL)),
    f"WITH RECURSIVE {sql_pairs(PAIRS)}, {CRITICAL}, {BOUNDS}, {HOLM.format('bounded')} "
    f"SELECT workload, comparison, n_blocks, {rs([*PAIRED, 'p_holm'])} FROM adjusted",
)
add(
    "two_arm_comparison",
    lambda spark, d: present(ex.two_arm_comparison(run_table(spark, d), ARMS[0], ARMS[1])),
    f"WITH RECURSIVE {sql_pairs([(ARMS[0], ARMS[1])])}, {CRITICAL}, {BOUNDS} "
    f"SELECT workload, comparison, n_blocks, {rs(PAIRED)} FROM bounded",
)


def _t_rows(spark, d) -> DataFrame:
    """A t statistic per nation: mean balance against zero."""
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("sd")
    )
    return per.where("n > 1").select(
        "c_nationkey",
        (F.col("n") - 1).alias("df"),
        ((F.col("m") - 4500.0) / (F.col("sd") / F.sqrt(F.col("n").cast("double")))).alias("t"),
    )


T_ROWS = """stats AS (SELECT c_nationkey, count(*) AS n_blocks,
      (avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(CAST(count(*) AS DOUBLE))) AS t
    FROM customer GROUP BY c_nationkey HAVING count(*) > 1)"""
add(
    "t_test_p_value",
    lambda spark, d: present(_t_rows(spark, d).withColumn("p", two_sided_p(F.col("t"), F.col("df")))),
    f"WITH {T_ROWS} SELECT c_nationkey, n_blocks - 1 AS df, {r('t', 't')}, {r(sql_p('t', '(n_blocks - 1)'), 'p')} FROM stats",
)
add(
    "t_interval",
    lambda spark, d: present(_t_rows(spark, d).select("c_nationkey", critical_value(F.col("df")).alias("t_crit"))),
    f"WITH RECURSIVE {T_ROWS}, {CRITICAL} SELECT c_nationkey, {r('t_crit', 't_crit')} FROM stats JOIN critical ON df = n_blocks - 1",
)


def _holm(spark, d) -> DataFrame:
    tests = _t_rows(spark, d).withColumn("p_raw", two_sided_p(F.col("t"), F.col("df")))
    regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("workload"), F.col("n_name").alias("comparison"))
    named = tests.join(regions, "c_nationkey")
    return ex.holm_adjust(named, ["workload"], tie=["comparison"]).select("workload", "comparison", "p_raw", "p_holm")


add(
    "holm_adjust",
    lambda spark, d: present(_holm(spark, d)),
    f"""WITH {T_ROWS}, tests AS (SELECT n_regionkey AS workload, n_name AS comparison, {sql_p('t', '(n_blocks - 1)')} AS p_raw
      FROM stats JOIN nation ON n_nationkey = c_nationkey), {HOLM.format('tests')}
    SELECT workload, comparison, {rs(['p_raw', 'p_holm'])} FROM adjusted""",
)
SUMMARY = ["total_mean", "total_std", "total_median", "extract_mean", "load_mean"]
add(
    "run_summary",
    lambda spark, d: present(ex.run_summary(run_table(spark, d), means=["extract_seconds", "load_seconds"]), 4),
    f"""WITH {RUNS}, q AS (SELECT workload, scenario, count(*) AS n, avg(total_seconds) AS total_mean, stddev_samp(total_seconds) AS total_std,
      quantile_cont(total_seconds, 0.5) AS total_median, avg(extract_seconds) AS extract_mean, avg(load_seconds) AS load_mean
      FROM runs GROUP BY workload, scenario) SELECT workload, scenario, n, {rs(SUMMARY, 4)} FROM q""",
)


def _scaling(spark, d) -> DataFrame:
    """Scenarios as machine sizes: the priority digit is the number of cores."""
    summary = group_summary(run_table(spark, d), ["scenario"], ["total_seconds"], None)
    sized = summary.select("scenario", "total_seconds_mean", F.substring("scenario", 1, 1).cast("int").alias("cores"))
    return ex.speedup_efficiency(sized, "1-URGENT", digits=None).orderBy("cores", "scenario")


add(
    "speedup_efficiency",
    lambda spark, d: present(_scaling(spark, d)),
    f"""WITH {RUNS}, q AS (SELECT scenario, avg(total_seconds) AS m, CAST(substr(scenario, 1, 1) AS INTEGER) AS cores FROM runs GROUP BY scenario),
    b AS (SELECT m AS base, cores AS base_cores FROM q WHERE scenario = '1-URGENT')
    SELECT scenario, {r('m', 'total_seconds_mean')}, cores, {r('base / m', 'speedup')},
           {r('base / m / (cores / CAST(base_cores AS DOUBLE))', 'efficiency')} FROM q CROSS JOIN b""",
)
add(
    "mean_std_text",
    lambda spark, d: mean_std_text(
        group_summary(run_table(spark, d), ["workload", "scenario"], ["total_seconds"], None),
        ["workload", "scenario"], ["total_seconds"],
    ),
    f"""WITH {RUNS} SELECT workload, scenario, printf('%.2f ± %.2f', avg(total_seconds), stddev_samp(total_seconds)) AS total_seconds_mean_std
    FROM runs GROUP BY workload, scenario""",
)


def _schedule(spark, d) -> DataFrame:
    runs = run_table(spark, d)
    cells = ex.run_cells(*[runs.select(c).distinct() for c in ("workload", "scenario", "block")])
    return ex.block_schedule(cells, SEED)


CELLS = """cells AS (SELECT * FROM (SELECT DISTINCT workload FROM runs) w CROSS JOIN (SELECT DISTINCT scenario FROM runs) s
      CROSS JOIN (SELECT DISTINCT block FROM runs) b)"""
SCHEDULE = f"""{RUNS}, {CELLS}, schedule AS (
      SELECT row_number() OVER (ORDER BY block, within_block_order) AS global_order,
             CASE WHEN block = 0 THEN 'warmup' ELSE 'measured' END AS phase, block, within_block_order, workload, scenario, CAST({SEED} AS BIGINT) AS seed
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY block ORDER BY {sql_hash(f"'{SEED}'", 'block', 'workload', 'scenario')}, workload, scenario) AS INTEGER) AS within_block_order FROM cells) q)"""
add("block_schedule", lambda spark, d: _schedule(spark, d).orderBy("global_order"), f"WITH {SCHEDULE} SELECT * FROM schedule")
add(
    "pending_cells",
    lambda spark, d: ex.pending_cells(_schedule(spark, d), run_table(spark, d), ["workload", "scenario", "block"]).select(
        "global_order", "workload", "scenario", "block"
    ),
    f"""WITH {SCHEDULE} SELECT global_order, workload, scenario, block FROM schedule s
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.status = 'ok' AND r.workload = s.workload AND r.scenario = s.scenario AND r.block = s.block)""",
)


def _upsert(spark, d) -> DataFrame:
    """Latest order per customer; pending orders are the incoming records."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    existing = orders.where(F.col("o_orderstatus") != "P")
    incoming = orders.where(F.col("o_orderstatus") == "P")
    return ex.upsert_latest(existing, incoming, "o_custkey", ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"
    )


add(
    "upsert_latest",
    _upsert,
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) q
    WHERE rn = 1""",
)
add(
    "completeness_gate",
    lambda spark, d: ex.gate_report(
        run_table(spark, d), 1200, run_table(spark, d).groupBy("workload").agg(F.max("feature_rows").alias("feature_rows"))
    ),
    f"""WITH {RUNS}, expected AS (SELECT workload, max(feature_rows) AS wanted FROM runs GROUP BY workload),
    rules AS (SELECT 'run_count' AS rule, abs(count(*) - 1200) AS offending FROM runs
      UNION ALL SELECT 'all_ok', count(CASE WHEN status <> 'ok' THEN 1 END) FROM runs
      UNION ALL SELECT 'input_format', count(CASE WHEN input_format <> 'parquet' THEN 1 END) FROM runs
      UNION ALL SELECT 'feature_rows', count(CASE WHEN feature_rows <> wanted THEN 1 END) FROM runs JOIN expected USING (workload))
    SELECT rule, offending, offending = 0 AS passed FROM rules""",
)


def _repair(spark, d) -> DataFrame:
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.replace(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    )
    raw = table(spark, d, "orders").select("o_orderkey", price.alias("total_seconds"))
    return repair_numbers(raw, ["total_seconds"])


add(
    "decimal_comma_repair",
    _repair,
    """SELECT o_orderkey, TRY_CAST(replace(total_seconds, ',', '.') AS DOUBLE) AS total_seconds FROM (
      SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
        ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') END AS total_seconds FROM orders) q""",
)

# ---- telemetry -------------------------------------------------------------------------------------


def event_lines(spark, d) -> DataFrame:
    """Line items written as event-log lines, some cut short and some of another kind."""
    lines = table(spark, d, "lineitem")
    whole = lambda c: F.floor(F.col(c)).cast("long")
    metrics = F.struct(
        whole("l_quantity").alias("Executor Run Time"),
        whole("l_extendedprice").alias("Executor CPU Time"),
        F.col("l_linenumber").cast("long").alias("JVM GC Time"),
        F.col("l_partkey").alias("Memory Bytes Spilled"),
        F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).alias("Disk Bytes Spilled"),
        F.struct(F.col("l_partkey").alias("Remote Bytes Read"), F.col("l_suppkey").alias("Local Bytes Read")).alias("Shuffle Read Metrics"),
        F.struct(F.col("l_orderkey").alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
        F.struct(whole("l_quantity").alias("Bytes Read")).alias("Input Metrics"),
    )
    event = F.to_json(F.struct(
        F.when(F.col("l_linenumber") == 1, F.lit("SparkListenerTaskStart")).otherwise(F.lit("SparkListenerTaskEnd")).alias("Event"),
        F.struct(F.when(F.col("l_returnflag") == "R", F.lit("FetchFailed")).otherwise(F.lit("Success")).alias("Reason")).alias("Task End Reason"),
        F.when(F.col("l_returnflag") != "A", metrics).alias("Task Metrics"),
    ))
    cut = F.when(F.col("l_linenumber") == 2, F.substring(event, 1, 60)).otherwise(event)
    return lines.select(F.col("l_suppkey").cast("string").alias("run_id"), cut.alias("value"))


_KEPT = "CASE WHEN l_returnflag <> 'A' THEN {0} END"
_ROLLUP = {
    "executor_run_ms": "CAST(floor(l_quantity) AS BIGINT)",
    "executor_cpu_ns": "CAST(floor(l_extendedprice) AS BIGINT)",
    "jvm_gc_ms": "l_linenumber",
    "memory_spill_bytes": "l_partkey",
    "disk_spill_bytes": "CASE WHEN l_linestatus = 'O' THEN l_suppkey END",
    "shuffle_read_bytes": "l_partkey + l_suppkey",
    "shuffle_write_bytes": "l_orderkey",
    "input_bytes": "CAST(floor(l_quantity) AS BIGINT)",
    "output_bytes": "0",
}
assert list(_ROLLUP) == list(TASK_TOTALS)
SQL_ROLLUP = f"""SELECT CAST(l_suppkey AS VARCHAR) AS run_id, count(*) AS tasks,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS failed_tasks, """ + ", ".join(
    f"CAST(coalesce(sum({_KEPT.format(e)}), 0) AS BIGINT) AS {n}" for n, e in _ROLLUP.items()
) + " FROM lineitem WHERE l_linenumber > 2 GROUP BY l_suppkey"
add("telemetry_rollup", lambda spark, d: telemetry_rollup(event_lines(spark, d)), SQL_ROLLUP)


def _joined_telemetry(spark, d) -> DataFrame:
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), F.col("s_acctbal").alias("total_seconds"))
    return with_telemetry(runs, event_lines(spark, d)).select("run_id", "total_seconds", "tasks", "failed_tasks")


def _manifest(spark, d) -> DataFrame:
    """Suppliers as runs: nations deal them out to three workloads and two scenarios; some names are warm-ups."""
    comma = F.regexp_replace(F.format_number(F.col("s_acctbal") + 2000, 2), ",", "")
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("run_id"),
        F.concat(F.lit("w"), F.col("s_nationkey") % 3).alias("workload"),
        F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("scenario"),
        F.floor(F.col("s_suppkey") / 2).alias("block"),
        F.when(F.col("s_suppkey") % 10 == 0, "warmup").otherwise("measured").alias("phase"),
        F.lit("ok").alias("status"), F.lit("parquet").alias("input_format"), F.lit(1).cast("long").alias("feature_rows"),
        F.regexp_replace(comma, r"\.", ",").alias("total_seconds"), F.lit(1.5).alias("extract_seconds"),
        F.col("s_acctbal").alias("load_seconds"),
    )


def _validation_summary(spark, d) -> DataFrame:
    manifest = _manifest(spark, d)
    return validation_analysis(manifest, event_lines(spark, d), manifest.count(), "even", ["odd"])["summary"]


_GIB = "CAST(1073741824 AS DOUBLE)"
_VALIDATION = {
    "total_mean": "avg(t)", "total_std": "stddev_samp(t)", "total_median": "quantile_cont(t, 0.5)", "extract_mean": "avg(1.5)",
    "load_mean": "avg(s_acctbal)", "executor_cpu_s": "avg(executor_cpu_ns) / 1e9", "gc_s": "avg(jvm_gc_ms) / 1e3",
    "shuffle_read_gb": f"avg(shuffle_read_bytes) / {_GIB}", "shuffle_write_gb": f"avg(shuffle_write_bytes) / {_GIB}",
    "spill_gb": f"avg(disk_spill_bytes) / {_GIB}",
}
add(
    "validation_summary",
    lambda spark, d: present(_validation_summary(spark, d)),
    f"""WITH rolled AS ({SQL_ROLLUP}),
    merged AS (SELECT 'w' || CAST(s_nationkey % 3 AS VARCHAR) AS workload, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS scenario,
        s_acctbal, round(s_acctbal + 2000, 2) AS t, rolled.*
      FROM supplier JOIN rolled ON run_id = CAST(s_suppkey AS VARCHAR) WHERE s_suppkey % 10 <> 0)
    SELECT workload, scenario, count(*) AS n, {', '.join(r(e, n) for n, e in _VALIDATION.items())}, CAST(sum(failed_tasks) AS BIGINT) AS failed_tasks
    FROM merged GROUP BY workload, scenario""",
)
add(
    "runs_with_telemetry",
    _joined_telemetry,
    f"SELECT run_id, s_acctbal AS total_seconds, tasks, failed_tasks FROM ({SQL_ROLLUP}) t JOIN supplier ON CAST(s_suppkey AS VARCHAR) = run_id",
)


def samples(spark, d) -> DataFrame:
    events = table(spark, d, "events")
    return events.select(
        F.col("user_id").alias("source"),
        "event_id",
        epoch_seconds(events, "ts").alias("timestamp"),
        F.col("value").alias("cpu_percent"),
        (F.col("value") / 2.0).alias("memory_percent"),
        F.col("value").alias("disk_read_mb_s"),
        (F.col("value") * 2.0).alias("disk_write_mb_s"),
    )


_SAMPLES = f"""samples AS (SELECT user_id AS source, event_id, value, {s.secs('ts')} AS t,
      min({s.secs('ts')}) OVER (PARTITION BY user_id) AS first_t FROM events)"""
add(
    "resource_alignment",
    lambda spark, d: present(resource_alignment(samples(spark, d)).select("event_id", "source", "elapsed_min", "disk_mb_s")),
    f"WITH {_SAMPLES} SELECT event_id, source, {r('(t - first_t) / CAST(60 AS DOUBLE)', 'elapsed_min')}, {r('value + value * 2', 'disk_mb_s')} FROM samples",
)
add(
    "resource_summary",
    lambda spark, d: present(resource_summary(resource_alignment(samples(spark, d)))),
    f"""WITH {_SAMPLES} SELECT source, count(*) AS samples, {r('max((t - first_t) / CAST(60 AS DOUBLE))', 'duration_min')},
    {r('avg(value)', 'cpu_percent_mean')}, {r('max(value)', 'cpu_percent_max')}, {r('avg(value / 2)', 'memory_percent_mean')},
    {r('max(value / 2)', 'memory_percent_max')}, {r('avg(value + value * 2)', 'disk_mb_s_mean')}, {r('max(value + value * 2)', 'disk_mb_s_max')}
    FROM samples GROUP BY source""",
)



def _incremental(spark, d) -> DataFrame:
    """Runs of the first months are written, scanned and marked; the next scan has the later ones only."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    runs = run_table(spark, d).select("run_id", "block", "feature_rows", "status")
    log = f"{folder}/taken"
    for batch, part in (("early", runs.where("block < 40")), ("late", runs.where("block >= 40"))):
        part.write.json(f"{folder}/records/{batch}")
        found = scan_new(spark, f"{folder}/records", log, batch, lambda paths: spark.read.schema(runs.schema).json(paths), "*.json")
        found.mark()
    return found.rows


add(
    "incremental_scan",
    _incremental,
    f"WITH {RUNS} SELECT run_id, block, feature_rows, status FROM runs WHERE block >= 40",
)

# ---- models (no SQL equivalent: iterative fits) ----------------------------------------------------


def customer_frame(spark, d) -> tuple[DataFrame, list[str]]:
    """Compact features of all customers as a model frame, computed once."""
    frame, features = model_frame(p.compact_features(s.cohort(spark, d), s.SETTINGS))
    return materialise(frame), features


def _split(spark, d):
    frame, features = customer_frame(spark, d)
    split = materialise(group_holdout(frame, "subject_id", "mortality_label", 42))
    prep = Preprocessor.fit(split.where(~F.col("is_test")), features)
    keep = ["hadm_id", "mortality_label"]
    train = prep.transform(split.where(~F.col("is_test")), keep)
    return train, prep.transform(split.where("is_test"), keep), prep.features


def _model(fit, **options):
    def build(spark, d) -> DataFrame:
        train, test, features = _split(spark, d)
        model = fit(train, features, "mortality_label", **options)
        return model.score(test, ["hadm_id", "mortality_label"]).select("hadm_id", F.col("mortality_label").alias("y"), "p")

    return build


def _importance(spark, d) -> DataFrame:
    train, _test, features = _split(spark, d)
    model = fit_forest(train, features, "mortality_label", trees=50, depth=12)
    return top_rows(model.importances(spark), "importance", "feature", 15)


def _calibrated(spark, d) -> DataFrame:
    frame, features = customer_frame(spark, d)
    settings = v.ValidationSettings(features, learners={"Logistic Regression": fit_logistic})
    return v.grouped_holdout_scores(frame, settings, repeats=1)


def _metric_summary(spark, d) -> DataFrame:
    frame, features = customer_frame(spark, d)
    settings = v.ValidationSettings(features, learners={"Logistic Regression": fit_logistic})
    scores = v.stratified_cv_scores(frame, settings)
    return v.metric_summary(v.metric_table(scores, "fold"))


add("logistic_model", _model(fit_logistic), None)
add("forest_model", _model(fit_forest, trees=50, depth=12), None)
add("boosted_model", _model(fit_boosted, rounds=30), None)
add("feature_importance", _importance, None)
add("platt_calibrated_scores", _calibrated, None)
add("metric_summary", _metric_summary, None)
