"""Analytics of repeated runs: schedules, gates, paired contrasts and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.tdist import critical_value, two_sided_p
from tidemark.operators.ranks import seeded_hash
from tidemark.operators.selection import exact_quantiles


MOST_LEVELS = 1000


class GateFailed(ValueError):
    """A run table does not meet a completeness rule."""


# ---- schedules ------------------------------------------------------------------------------


def run_cells(workloads: DataFrame, scenarios: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every workload with every scenario in every block.

    The factors of a design are short lists of levels, so two of them become constants
    that each block row is expanded by; a factor too long for that is refused.
    """
    cells = blocks
    for factor in (workloads, scenarios):
        name = factor.columns[0]
        levels = [row[0] for row in factor.limit(MOST_LEVELS + 1).collect()]
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"factor {name} has more than {MOST_LEVELS} levels")
        kind = factor.schema[name].dataType
        cells = cells.withColumn(name, F.explode(F.array(*[F.lit(level).cast(kind) for level in levels])))
    return cells


def block_schedule(cells: DataFrame, seed: int, block: str = "block", ids: Sequence[str] = ("workload", "scenario")) -> DataFrame:
    """Randomised complete-block schedule: seeded order inside each block, block after block.

    Block 0 is the warm-up. Every block holds the same number of cells, so the global
    order follows from the block's rank and needs no sort over all runs.
    """
    order = seeded_hash(seed, block, *ids)
    within = F.row_number().over(Window.partitionBy(block).orderBy(order, *ids))
    sizes = cells.groupBy(block).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(block).alias("__block"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    placed = cells.withColumn("within_block_order", within).join(offsets, F.col(block) == F.col("__block"))
    return placed.select(
        (F.col("__before") + F.col("within_block_order")).alias("global_order"),
        F.when(F.col(block) == 0, F.lit("warmup")).otherwise(F.lit("measured")).alias("phase"),
        block,
        "within_block_order",
        *ids,
        F.lit(seed).cast("long").alias("seed"),
    )


def pending_cells(schedule: DataFrame, runs: DataFrame, keys: Sequence[str], ok: str = "ok") -> DataFrame:
    """Cells of the schedule without a successful run."""
    return schedule.join(runs.where(F.col("status") == ok).select(*keys), list(keys), "left_anti")


def upsert_latest(
    existing: DataFrame, incoming: DataFrame, key: str, version: Sequence[str]
) -> DataFrame:
    """One record per key, the incoming one where both have it, then the highest version.

    A maximum over a struct combines on the map side; no window over the key is needed.
    """
    both = existing.withColumn("__newer", F.lit(0)).unionByName(incoming.withColumn("__newer", F.lit(1)))
    rest = [c for c in existing.columns if c != key]
    rank = F.struct("__newer", *version)
    picked = both.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("__kept"))
    return picked.select(*[F.col(key) if c == key else F.col("__kept")[c].alias(c) for c in existing.columns])


# ---- completeness gates ------------------------------------------------------------------------


def gate_report(
    runs: DataFrame, expected_runs: int, expected_rows: DataFrame | None = None, input_format: str = "parquet"
) -> DataFrame:
    """(rule, offending, passed): run count, all ok, one input format, product row counts."""
    total = runs.agg(F.count(F.lit(1)).alias("__n"))
    rules = [
        total.select(F.lit("run_count").alias("rule"), F.abs(F.col("__n") - F.lit(expected_runs)).alias("offending")),
        runs.agg(F.count_if(~F.col("status").eqNullSafe(F.lit("ok"))).alias("offending")).select(
            F.lit("all_ok").alias("rule"), "offending"
        ),
        runs.agg(F.count_if(~F.col("input_format").eqNullSafe(F.lit(input_format))).alias("offending")).select(
            F.lit("input_format").alias("rule"), "offending"
        ),
    ]
    if expected_rows is not None:
        wanted = expected_rows.select(F.col("workload").alias("__w"), F.col("feature_rows").alias("__rows"))
        joined = runs.join(wanted, F.col("workload") == F.col("__w"), "left")
        rules.append(
            joined.agg(F.count_if(~F.col("feature_rows").eqNullSafe(F.col("__rows"))).alias("offending")).select(
                F.lit("feature_rows").alias("rule"), "offending"
            )
        )
    report = rules[0]
    for rule in rules[1:]:
        report = report.unionByName(rule)
    return report.withColumn("passed", F.col("offending") == 0)


def assert_gates(report: DataFrame) -> None:
    """Raise with every failed rule of a gate report."""
    failed = {row["rule"]: row["offending"] for row in report.where(~F.col("passed")).collect()}
    if failed:
        raise GateFailed(f"incomplete run matrix: {failed}")


# ---- paired comparisons -------------------------------------------------------------------------


def block_pivot(
    runs: DataFrame, scenarios: Sequence[str], family: str = "workload", block: str = "block",
    scenario: str = "scenario", measure: str = "total_seconds",
) -> DataFrame:
    """One row per (family, block), one column per scenario, null where a run is missing."""
    columns = [F.max(F.when(F.col(scenario) == s, F.col(measure))).alias(s) for s in scenarios]
    return runs.groupBy(family, block).agg(*columns)


def paired_statistics(
    pivoted: DataFrame, pairs: Sequence[tuple[str, str]], family: str = "workload", confidence: float = 0.95
) -> DataFrame:
    """For each (arm, control): n, differences, geometric ratio, t interval of both, paired t and p.

    Blocks lacking one of the two arms are left out of that pair.
    """
    sides = F.array(*[
        F.struct(
            F.lit(f"{arm} - {control}").alias("comparison"),
            F.col(arm).cast("double").alias("__arm"),
            F.col(control).cast("double").alias("__control"),
        )
        for arm, control in pairs
    ])
    long = pivoted.select(family, F.inline(sides)).where(F.col("__arm").isNotNull() & F.col("__control").isNotNull())
    gap, ratio = F.col("__arm") - F.col("__control"), F.log(F.col("__arm") / F.col("__control"))
    stats = long.groupBy(family, "comparison").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.avg("__arm").alias("arm_mean"),
        F.stddev_samp("__arm").alias("arm_std"),
        F.avg("__control").alias("control_mean"),
        F.stddev_samp("__control").alias("control_std"),
        F.avg(gap).alias("mean_difference"),
        F.stddev_samp(gap).alias("__gap_sd"),
        F.avg(ratio).alias("__log_mean"),
        F.stddev_samp(ratio).alias("__log_sd"),
    )
    root = F.sqrt(F.col("n_blocks").cast("double"))
    df = (F.col("n_blocks") - F.lit(1)).cast("int")
    spread = stats.withColumn("__t_crit", critical_value(df, confidence)).withColumn(
        "paired_t", F.try_divide(F.col("mean_difference"), F.col("__gap_sd") / root)
    )
    half, log_half = F.col("__t_crit") * F.col("__gap_sd") / root, F.col("__t_crit") * F.col("__log_sd") / root
    return spread.select(
        family,
        "comparison",
        "n_blocks",
        "arm_mean",
        "arm_std",
        "control_mean",
        "control_std",
        "mean_difference",
        (F.col("mean_difference") - half).alias("difference_ci_low"),
        (F.col("mean_difference") + half).alias("difference_ci_high"),
        F.exp("__log_mean").alias("geometric_ratio"),
        F.exp(F.col("__log_mean") - log_half).alias("ratio_ci_low"),
        F.exp(F.col("__log_mean") + log_half).alias("ratio_ci_high"),
        "paired_t",
        two_sided_p(F.col("paired_t"), df).alias("p_raw"),
    )


def holm_adjust(tests: DataFrame, family: Sequence[str], p: str = "p_raw", tie: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Holm step-down inside each family: running maximum of (m - rank) * p, at most 1.

    A family is a handful of planned comparisons.
    """
    ranked = Window.partitionBy(*family).orderBy(F.col(p), *tie)
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    scaled = tests.withColumn("__scaled", (size - F.row_number().over(ranked) + F.lit(1)) * F.col(p))
    return scaled.withColumn(name, F.least(F.lit(1.0), F.max("__scaled").over(upto))).drop("__scaled")


def paired_contrasts(
    runs: DataFrame, arms: Sequence[str], control: str, family: str = "workload", confidence: float = 0.95
) -> DataFrame:
    """Every arm against the control inside blocks, with Holm adjustment per family."""
    pivoted = block_pivot(runs, [control, *arms], family)
    stats = paired_statistics(pivoted, [(arm, control) for arm in arms], family, confidence)
    return holm_adjust(stats, [family], tie=["comparison"])


def two_arm_comparison(
    runs: DataFrame, arm: str, control: str, family: str = "workload", confidence: float = 0.95
) -> DataFrame:
    """One planned comparison per family, without multiplicity adjustment."""
    return paired_statistics(block_pivot(runs, [arm, control], family), [(arm, control)], family, confidence)


# ---- summaries ------------------------------------------------------------------------------------


def run_summary(
    runs: DataFrame,
    by: Sequence[str] = ("workload", "scenario"),
    measure: str = "total_seconds",
    means: Sequence[str] = ("extract_seconds", "transform_seconds", "load_seconds"),
    telemetry: bool = False,
) -> DataFrame:
    """n, mean, std and exact median of a measure, means of stages, optional telemetry in s and GiB."""
    by = list(by)
    columns = [
        F.count(F.lit(1)).alias("n"),
        F.avg(measure).alias("total_mean"),
        F.stddev_samp(measure).alias("total_std"),
        *[F.avg(m).alias(f"{m.removesuffix('_seconds')}_mean") for m in means],
    ]
    if telemetry:
        gib = F.lit(1024.0 ** 3)
        columns += [
            (F.avg("executor_cpu_ns") / F.lit(1e9)).alias("executor_cpu_s"),
            (F.avg("jvm_gc_ms") / F.lit(1e3)).alias("gc_s"),
            (F.avg("shuffle_read_bytes") / gib).alias("shuffle_read_gb"),
            (F.avg("shuffle_write_bytes") / gib).alias("shuffle_write_gb"),
            (F.avg("disk_spill_bytes") / gib).alias("spill_gb"),
            F.sum("failed_tasks").alias("failed_tasks"),
        ]
    middle = exact_quantiles(runs, by, measure, [0.5]).select(*by, F.col("quantile").alias("total_median"))
    return runs.groupBy(*by).agg(*columns).join(middle, by, "left")


def speedup_efficiency(
    summary: DataFrame, baseline: str, scenario: str = "scenario", mean: str = "total_seconds_mean",
    cores: str = "cores", digits: int | None = 3,
) -> DataFrame:
    """Speed-up over a named baseline scenario, and efficiency per unit of relative capacity.

    The baseline is named, and efficiency divides by the capacity relative to it.
    """
    named = F.col(scenario) == F.lit(baseline)
    whole = Window.partitionBy(F.lit(0))  # one row per scenario
    based = summary.select(
        "*",
        F.max(F.when(named, F.col(mean))).over(whole).alias("__base"),
        F.max(F.when(named, F.col(cores))).over(whole).alias("__base_cores"),
    )
    speed = F.col("__base") / F.col(mean)
    efficiency = speed / (F.col(cores) / F.col("__base_cores"))
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return based.select(
        *summary.columns, rounded(speed).alias("speedup"), rounded(efficiency).alias("efficiency")
    )
