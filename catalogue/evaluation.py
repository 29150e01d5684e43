"""Split, preprocessing and metric queries over orders.

A row is an order, its group the customer and its label whether the order is filled. The
score of an order is its price on a grid of ten thousand steps, so many scores tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalogue.common import Entry, present, r, rs, table
from tidemark.operators import evaluate as ev
from tidemark.operators import splits as sp
from tidemark.operators.neighbours import neighbour_information
from tidemark.operators.prep import Preprocessor, column_quantiles, impute, mutual_information
from tidemark.session import materialise

SEED = 42
ENTRIES: dict[str, Entry] = {}


def add(name: str, build, sql: str | None) -> None:
    ENTRIES[name] = Entry(build, sql)


def labelled(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )


LABELLED = "labelled AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders)"


def sql_hash(seed: str, *ids: str) -> str:
    return f"md5(concat_ws('-', {seed}, {', '.join(ids)}))"


# ---- splits ------------------------------------------------------------------------------------

add(
    "stratified_holdout",
    lambda spark, d: sp.stratified_holdout(labelled(spark, d), "y", ["o_orderkey"], SEED).select(
        "o_orderkey", F.col("is_test").cast("int").alias("is_test")
    ),
    f"""WITH {LABELLED}, ranked AS (
      SELECT o_orderkey, row_number() OVER (PARTITION BY y ORDER BY {sql_hash("'42'", 'o_orderkey')}, o_orderkey) AS n,
             count(*) OVER (PARTITION BY y) AS total FROM labelled)
    SELECT o_orderkey, CASE WHEN n <= round(total * 0.2) THEN 1 ELSE 0 END AS is_test FROM ranked""",
)
add(
    "stratified_kfold",
    lambda spark, d: sp.stratified_folds(labelled(spark, d), "y", ["o_orderkey"], SEED).select("o_orderkey", "fold"),
    f"""WITH {LABELLED}
    SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY y ORDER BY {sql_hash("'42'", 'o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
    FROM labelled""",
)


def sql_group_folds(source: str, seed: int, name: str, folds: int = 5) -> str:
    return f"""(SELECT o_custkey, CAST((row_number() OVER (ORDER BY n_pos, n_rows, {sql_hash(f"'{seed}'", 'o_custkey')}, o_custkey) - 1) % {folds} AS INTEGER) AS {name}
      FROM (SELECT o_custkey, sum(y) AS n_pos, count(*) AS n_rows FROM {source} GROUP BY o_custkey) g)"""


add(
    "grouped_kfold",
    lambda spark, d: sp.with_group_folds(labelled(spark, d), "o_custkey", "y", SEED).select("o_orderkey", "o_custkey", "fold"),
    f"WITH {LABELLED} SELECT o_orderkey, o_custkey, fold FROM labelled JOIN {sql_group_folds('labelled', 42, 'fold')} f USING (o_custkey)",
)

# The greedy placement as a walk over the groups; positions of a stratum beyond the first twenty are dealt in turn.
_WALK = f"""sizes AS (SELECT o_custkey, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM labelled GROUP BY o_custkey),
totals AS (SELECT CAST(greatest(sum(pos), 1) AS HUGEINT) AS tp, CAST(greatest(sum(n - pos), 1) AS HUGEINT) AS tn FROM sizes),
placed AS (SELECT o_custkey, pos, n - pos AS neg,
    row_number() OVER (PARTITION BY pos, n ORDER BY {sql_hash("'42'", 'o_custkey')}, o_custkey) - 1 AS j, count(*) OVER (PARTITION BY pos, n) AS c,
    row_number() OVER (ORDER BY abs(2 * pos - n) DESC, n DESC, pos DESC, {sql_hash("'42'", 'o_custkey')}, o_custkey) AS i FROM sizes),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS o_custkey, CAST(1 AS BIGINT) AS f, CAST([0, 0, 0, 0, 0] AS HUGEINT[]) AS ps, CAST([0, 0, 0, 0, 0] AS HUGEINT[]) AS ns
  UNION ALL
  SELECT i, o_custkey, f, list_transform(range(1, 6), lambda k: ps[k] + CASE WHEN k = f THEN pos ELSE 0 END),
         list_transform(range(1, 6), lambda k: ns[k] + CASE WHEN k = f THEN neg ELSE 0 END)
  FROM (SELECT p.i, p.o_custkey, pos, neg, ps, ns,
          CASE WHEN j >= 20 AND j < 20 + (c - 20) // 5 * 5 THEN (j - 20) % 5 + 1
               ELSE list_sort(list_transform(range(1, 6), lambda k: {{'s': ps[k] * pos * tn * tn + ns[k] * neg * tp * tp, 'r': ps[k] + ns[k], 'f': k}}))[1].f END AS f
        FROM walk w JOIN placed p ON p.i = w.i + 1 CROSS JOIN totals) step)"""
add(
    "balanced_group_folds",
    lambda spark, d: sp.balanced_group_folds(labelled(spark, d), "o_custkey", "y", SEED),
    f"WITH RECURSIVE {LABELLED}, {_WALK} SELECT o_custkey, CAST(f - 1 AS INTEGER) AS fold FROM walk WHERE i > 0",
)

HOLDOUT_SEEDS = list(range(SEED, SEED + 30))


def _holdouts(spark, d) -> DataFrame:
    return sp.repeated_group_holdouts(labelled(spark, d), "o_custkey", "y", HOLDOUT_SEEDS)


HOLDOUTS = f"""sizes AS (SELECT o_custkey, sum(y) AS n_pos, count(*) AS n_rows FROM labelled GROUP BY o_custkey),
dealt AS (SELECT seed, o_custkey, (row_number() OVER (PARTITION BY seed ORDER BY n_pos, n_rows, {sql_hash('seed', 'o_custkey')}, o_custkey) - 1) % 5 AS fold
          FROM sizes, (SELECT unnest(range({HOLDOUT_SEEDS[0]}, {HOLDOUT_SEEDS[-1] + 1})) AS seed) seeds),
holdouts AS (SELECT CAST(seed AS INTEGER) AS seed, o_orderkey, o_custkey, y, fold = 0 AS is_test FROM labelled JOIN dealt USING (o_custkey))"""
add(
    "grouped_holdout",
    lambda spark, d: _holdouts(spark, d).where("is_test").select("seed", "o_orderkey"),
    f"WITH {LABELLED}, {HOLDOUTS} SELECT seed, o_orderkey FROM holdouts WHERE is_test",
)


def _nested(spark, d) -> DataFrame:
    outer = sp.group_holdout(labelled(spark, d), "o_custkey", "y", SEED)
    return sp.nested_group_folds(outer, "o_custkey", "y", SEED).select("o_orderkey", "inner_fold")


add(
    "nested_grouped_kfold",
    _nested,
    f"""WITH {LABELLED}, training AS (
      SELECT o_orderkey, o_custkey, y FROM labelled JOIN {sql_group_folds('labelled', 42, 'fold')} f USING (o_custkey) WHERE fold <> 0)
    SELECT o_orderkey, inner_fold FROM training JOIN {sql_group_folds('training', 42, 'inner_fold')} g USING (o_custkey)""",
)


def _disjointness(spark, d) -> DataFrame:
    """Customers on both sides: none for a grouped split, many for a row-wise one."""
    rows = labelled(spark, d)
    grouped = sp.group_holdout(rows, "o_custkey", "y", SEED)
    plain = sp.stratified_holdout(rows, "y", ["o_orderkey"], SEED)
    counts = [
        sp.leaking_groups(split, "o_custkey", "is_test").agg(F.count(F.lit(1)).alias("leaking")).select(
            F.lit(name).alias("split"), "leaking"
        )
        for name, split in (("grouped", grouped), ("stratified", plain))
    ]
    return counts[0].unionByName(counts[1])


add(
    "fold_disjointness",
    _disjointness,
    f"""WITH {LABELLED}, ranked AS (
      SELECT o_custkey, row_number() OVER (PARTITION BY y ORDER BY {sql_hash("'42'", 'o_orderkey')}, o_orderkey) AS n,
             count(*) OVER (PARTITION BY y) AS total FROM labelled)
    SELECT 'grouped' AS split, CAST(0 AS BIGINT) AS leaking
    UNION ALL SELECT 'stratified' AS split, count(*) AS leaking FROM (
      SELECT o_custkey FROM ranked GROUP BY o_custkey
      HAVING max(CASE WHEN n <= round(total * 0.2) THEN 1 ELSE 0 END) <> min(CASE WHEN n <= round(total * 0.2) THEN 1 ELSE 0 END)) l""",
)
DIAGNOSTICS = ["positive_rate_train", "positive_rate_test"]


def sql_diagnostics(source: str, test: str, by: str) -> str:
    return f"""SELECT {by}, count(DISTINCT CASE WHEN NOT ({test}) THEN o_custkey END) AS n_groups_train,
      count(DISTINCT CASE WHEN {test} THEN o_custkey END) AS n_groups_test,
      count(CASE WHEN NOT ({test}) THEN 1 END) AS n_rows_train, count(CASE WHEN {test} THEN 1 END) AS n_rows_test,
      {r(f'avg(CASE WHEN NOT ({test}) THEN y END)', 'positive_rate_train')}, {r(f'avg(CASE WHEN {test} THEN y END)', 'positive_rate_test')}
      FROM {source} GROUP BY {by}"""


add(
    "split_diagnostics",
    lambda spark, d: present(sp.split_diagnostics(_holdouts(spark, d), "o_custkey", "y", by=["seed"])),
    f"WITH {LABELLED}, {HOLDOUTS} {sql_diagnostics('holdouts', 'is_test', 'seed')}",
)
add(
    "fold_diagnostics",
    lambda spark, d: present(
        sp.fold_diagnostics(sp.with_group_folds(labelled(spark, d), "o_custkey", "y", SEED), "o_custkey", "y")
    ),
    f"""WITH {LABELLED}, dealt AS (SELECT o_custkey, y, fold FROM labelled JOIN {sql_group_folds('labelled', 42, 'fold')} f USING (o_custkey)),
    turns AS (SELECT t.fold AS turn, d.* FROM (SELECT DISTINCT fold FROM dealt) t CROSS JOIN dealt d)
    SELECT turn AS fold, * EXCLUDE (turn) FROM ({sql_diagnostics('turns', 'fold = turn', 'turn')}) q""",
)
add(
    "balanced_weights",
    lambda spark, d: present(sp.balanced_weights(labelled(spark, d), "y")),
    f"""WITH {LABELLED} SELECT y, {r('CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*))', 'weight')}
    FROM labelled GROUP BY y""",
)

# ---- preprocessing -----------------------------------------------------------------------------

COLUMNS = ["balance", "first_day", "spend", "n_orders"]


def sparse_frame(spark, d) -> DataFrame:
    """One row per customer with missing values, computed once; low nation numbers are the training side."""
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("spend"),
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.datediff(F.min("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("first_day"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("filled"),
    )
    joined = table(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    balance = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal"))
    late = F.when(F.col("c_mktsegment") != "BUILDING", F.col("first_day"))
    return materialise(joined.select(
        "c_custkey",
        (F.col("c_nationkey") < 18).alias("is_train"),
        F.when(F.col("filled") >= 0.5, 1).otherwise(0).alias("settled"),
        balance.alias("balance"),
        late.alias("first_day"),
        "spend",
        "n_orders",
    ))


SPARSE = """spent AS (
  SELECT o_custkey, sum(o_totalprice) AS spend, CAST(count(*) AS DOUBLE) AS n_orders,
         CAST(date_diff('day', DATE '1995-01-01', CAST(min(o_orderdate) AS DATE)) AS DOUBLE) AS first_day,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS filled
  FROM orders GROUP BY o_custkey),
sparse AS (
  SELECT c_custkey, c_nationkey < 18 AS is_train, CASE WHEN filled >= 0.5 THEN 1 ELSE 0 END AS settled,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS balance,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN first_day END AS first_day, spend, n_orders
  FROM customer LEFT JOIN spent ON o_custkey = c_custkey)"""
IMPUTED = SPARSE + ", medians AS (SELECT " + ", ".join(f"median({c}) AS {c}_mid" for c in COLUMNS) + " FROM sparse WHERE is_train), imputed AS (SELECT c_custkey, is_train, " + ", ".join(
    f"coalesce({c}, {c}_mid) AS {c}" for c in COLUMNS
) + " FROM sparse CROSS JOIN medians)"
CLIPPED = IMPUTED + ", cuts AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS {c}_low, quantile_cont({c}, 0.99) AS {c}_high" for c in COLUMNS
) + " FROM imputed WHERE is_train), clipped AS (SELECT c_custkey, is_train, " + ", ".join(
    f"least(greatest({c}, {c}_low), {c}_high) AS {c}" for c in COLUMNS
) + " FROM imputed CROSS JOIN cuts)"
SCALED = CLIPPED + ", moments AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_mean, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_sd" for c in COLUMNS
) + " FROM clipped WHERE is_train), scaled AS (SELECT c_custkey, " + ", ".join(
    f"({c} - {c}_mean) / {c}_sd AS {c}" for c in COLUMNS
) + " FROM clipped CROSS JOIN moments)"


def _median_impute(spark, d) -> DataFrame:
    rows = sparse_frame(spark, d)
    centre = column_quantiles(rows.where("is_train"), COLUMNS, [0.5])
    return rows.select("c_custkey", *[impute(c, centre[c][0]) for c in COLUMNS])


def _quantile_clip(spark, d) -> DataFrame:
    rows = sparse_frame(spark, d)
    return Preprocessor.fit(rows.where("is_train"), COLUMNS, scale=False).transform(rows, ["c_custkey"])


def _standardise(spark, d) -> DataFrame:
    rows = sparse_frame(spark, d)
    return Preprocessor.fit(rows.where("is_train"), COLUMNS).transform(rows, ["c_custkey"])


add("median_impute", lambda spark, d: present(_median_impute(spark, d), 4), f"WITH {IMPUTED} SELECT c_custkey, {rs(COLUMNS, 4)} FROM imputed")
add("quantile_clip", lambda spark, d: present(_quantile_clip(spark, d), 4), f"WITH {CLIPPED} SELECT c_custkey, {rs(COLUMNS, 4)} FROM clipped")
add("standardise", lambda spark, d: present(_standardise(spark, d)), f"WITH {SCALED} SELECT c_custkey, {rs(COLUMNS)} FROM scaled")

_MI_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, settled, {c} AS v FROM sparse WHERE {c} IS NOT NULL" for c in COLUMNS)
_MI_EDGES = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(1, 10))
add(
    "mutual_information_topk",
    lambda spark, d: present(mutual_information(sparse_frame(spark, d), COLUMNS, "settled", top=2)),
    f"""WITH {SPARSE}, long AS ({_MI_LONG}),
    edges AS (SELECT feature, [{_MI_EDGES}] AS e FROM long GROUP BY feature),
    binned AS (SELECT l.feature, settled, len(list_filter(e, lambda z: z < v)) AS b FROM long l JOIN edges USING (feature)),
    cells AS (SELECT feature, b, settled, CAST(count(*) AS DOUBLE) AS n FROM binned GROUP BY feature, b, settled),
    parts AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb,
                     sum(n) OVER (PARTITION BY feature, settled) AS nc FROM cells)
    SELECT feature, {r('sum(n / t * ln(n * t / (nb * nc)))', 'mutual_information')}
    FROM parts GROUP BY feature ORDER BY sum(n / t * ln(n * t / (nb * nc))) DESC, feature LIMIT 2""",
)



def _neighbour_information(spark, d) -> DataFrame:
    # Sums of prices are rounded, so that distances do not depend on the order of summation.
    rows = sparse_frame(spark, d).withColumn("spend", F.round("spend"))
    return neighbour_information(rows, COLUMNS, "settled")


add(
    "mutual_information_neighbours",
    lambda spark, d: present(_neighbour_information(spark, d)),
    f"""WITH {SPARSE}, long AS ({_MI_LONG}),
    sized AS (SELECT feature, settled AS y, CASE WHEN feature = 'spend' THEN round(v) ELSE v END AS v,
                     count(*) OVER (PARTITION BY feature, settled) AS nc, row_number() OVER () AS id FROM long),
    kept AS (SELECT * FROM sized WHERE nc > 1),
    near AS (SELECT a.id, a.feature, a.v, a.nc, least(3, a.nc - 1) AS k, abs(a.v - b.v) AS far,
                    row_number() OVER (PARTITION BY a.id ORDER BY abs(a.v - b.v)) AS turn
             FROM kept a JOIN kept b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id),
    kth AS (SELECT * FROM near WHERE turn = k),
    within AS (SELECT a.id, count(*) AS m FROM kth a JOIN kept b ON a.feature = b.feature
               AND CASE WHEN a.far > 0 THEN b.v > a.v - a.far AND b.v < a.v + a.far ELSE b.v = a.v END GROUP BY a.id),
    psi AS (SELECT n, -0.5772156649015329 + coalesce(sum(1.0 / n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
            FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM customer))) AS n) t),
    parts AS (SELECT feature, pk.p - pc.p - pm.p AS part, count(*) OVER (PARTITION BY feature) AS total
              FROM kth JOIN within USING (id) JOIN psi pk ON pk.n = k JOIN psi pc ON pc.n = nc JOIN psi pm ON pm.n = m)
    SELECT feature, {r('greatest(0, max(pn.p) + avg(part))', 'mutual_information')}
    FROM parts JOIN psi pn ON pn.n = total GROUP BY feature""",
)

# ---- metrics -------------------------------------------------------------------------------------

BY = ["model"]


def scored(spark, d) -> DataFrame:
    steps = F.floor(F.col("o_totalprice") / F.lit(51.0)).cast("double")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("model"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (steps / F.lit(10000.0)).alias("p"),
    )


SCORED = """scored AS (SELECT o_orderkey, o_orderpriority AS model, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
  floor(o_totalprice / CAST(51 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS p FROM orders)"""
CONFUSION = ["accuracy", "balanced_accuracy", "precision", "recall_sensitivity", "specificity", "f1", "mcc"]
add(
    "confusion_metrics",
    lambda spark, d: present(ev.confusion_metrics(scored(spark, d), by=BY)),
    f"""WITH {SCORED}, counts AS (
      SELECT model, count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) AS tn, count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp,
             count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp
      FROM scored GROUP BY model),
    rates AS (SELECT *, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy,
      coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall_sensitivity,
      tn / CAST(nullif(tn + fp, 0) AS DOUBLE) AS specificity, coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1,
      coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0) AS mcc,
      (tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2 AS balanced_accuracy FROM counts)
    SELECT model, {rs(CONFUSION)}, tn, fp, fn, tp FROM rates""",
)
add(
    "auroc",
    lambda spark, d: present(ev.ranking_metrics(scored(spark, d), by=BY).select("model", "auroc")),
    f"""WITH {SCORED}, ranked AS (
      SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / CAST(2 AS DOUBLE) AS rk FROM scored),
    sums AS (SELECT model, sum(CASE WHEN y = 1 THEN rk END) AS rs, CAST(sum(y) AS DOUBLE) AS np, CAST(sum(1 - y) AS DOUBLE) AS nn FROM ranked GROUP BY model)
    SELECT model, {r('(rs - np * (np + 1) / 2) / (np * nn)', 'auroc')} FROM sums""",
)
STEPS = f"""{SCORED}, tied AS (SELECT model, p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY model, p),
    steps AS (SELECT model, p, pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS said,
                     CAST(sum(pos) OVER (PARTITION BY model) AS DOUBLE) AS np, CAST(sum(n) OVER (PARTITION BY model) AS DOUBLE) AS nt
              FROM tied WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""
add(
    "average_precision",
    lambda spark, d: present(ev.ranking_metrics(scored(spark, d), by=BY).select("model", "auprc")),
    f"WITH {STEPS} SELECT model, {r('sum(pos / np * tp / said)', 'auprc')} FROM steps GROUP BY model",
)
add(
    "brier",
    lambda spark, d: present(ev.brier_metrics(scored(spark, d), by=BY).select("model", "brier_score")),
    f"WITH {SCORED} SELECT model, {r('avg((p - y) * (p - y))', 'brier_score')} FROM scored GROUP BY model",
)
add(
    "brier_skill",
    lambda spark, d: present(ev.brier_metrics(scored(spark, d), by=BY).select("model", "brier_skill_score")),
    f"WITH {SCORED} SELECT model, {r('1 - avg((p - y) * (p - y)) / nullif(avg(y) * (1 - avg(y)), 0)', 'brier_skill_score')} FROM scored GROUP BY model",
)
_EDGES = ", ".join(f"quantile_cont(p, {i / 10})" for i in range(1, 10))
add(
    "calibration_curve",
    lambda spark, d: present(ev.reliability_curve(scored(spark, d), by=BY)),
    f"""WITH {SCORED}, edges AS (SELECT model, [{_EDGES}] AS e FROM scored GROUP BY model),
    binned AS (SELECT s.model, y, p, CAST(len(list_filter(e, lambda z: z < p)) AS INTEGER) AS bin FROM scored s JOIN edges USING (model))
    SELECT model, bin, {r('avg(p)', 'mean_predicted')}, {r('avg(y)', 'frac_positive')}, count(*) AS n FROM binned GROUP BY model, bin""",
)


def sql_newton(source: str, iterations: int, ridge: float) -> str:
    """Newton steps of a one-variable logistic fit of y on x per model, one table expression each."""
    steps = [f"fit0 AS (SELECT DISTINCT model, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM {source})"]
    for i in range(iterations):
        steps.append(
            f"""sums{i} AS (SELECT model, max(a) AS a, max(b) AS b, sum(y - mu) AS g0, sum((y - mu) * x) - {ridge} * max(b) AS g1,
              sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * x) AS h01, sum(mu * (1 - mu) * x * x) + {ridge} AS h11
              FROM (SELECT s.model, y, x, a, b, 1 / (1 + exp(-(a + b * x))) AS mu FROM {source} s JOIN fit{i} f ON s.model = f.model) q GROUP BY model),
            fit{i + 1} AS (SELECT model, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a,
              b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM sums{i})"""
        )
    return ", ".join(steps)


add(
    "calibration_line",
    lambda spark, d: present(ev.calibration_line(scored(spark, d), by=BY)),
    f"""WITH {SCORED}, logits AS (SELECT model, CAST(y AS DOUBLE) AS y, ln(q / (1 - q)) AS x FROM (
      SELECT model, y, least(greatest(p, CAST(1e-6 AS DOUBLE)), 1 - CAST(1e-6 AS DOUBLE)) AS q FROM scored) b),
    {sql_newton('logits', 12, 1.0)}
    SELECT model, {r('a', 'calibration_intercept')}, {r('b', 'calibration_slope')} FROM fit12""",
)
add(
    "roc_points",
    lambda spark, d: present(ev.roc_points(scored(spark, d), by=BY)),
    f"""WITH {STEPS}
    SELECT model, {r('p', 'threshold')}, {r('(said - tp) / (nt - np)', 'fpr')}, {r('tp / np', 'tpr')} FROM steps
    UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM scored""",
)
add(
    "pr_points",
    lambda spark, d: present(ev.pr_points(scored(spark, d), by=BY)),
    f"""WITH {STEPS}
    SELECT model, {r('p', 'threshold')}, {r('tp / said', 'precision')}, {r('tp / np', 'recall')} FROM steps
    UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM scored""",
)


def quality_scores(spark, d) -> DataFrame:
    """Document quality labels scored by document length."""
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    p = F.col("n_chars") / (F.col("n_chars") + F.lit(800.0))
    return joined.select(F.col("lang").alias("model"), F.col("quality").alias("y"), p.alias("p"))


def _quality(spark, d) -> DataFrame:
    rows = quality_scores(spark, d)
    counts = ev.confusion_metrics(rows, by=BY).select("model", "tn", "fp", "fn", "tp")
    return counts.join(ev.brier_metrics(rows, by=BY), "model").join(ev.ranking_metrics(rows, by=BY), "model")


add(
    "length_score_quality",
    lambda spark, d: present(_quality(spark, d)),
    f"""WITH scored AS (SELECT lang AS model, quality AS y, n_chars / (n_chars + CAST(800 AS DOUBLE)) AS p FROM labels JOIN documents USING (doc_id)),
    ranked AS (SELECT model, y, p, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / CAST(2 AS DOUBLE) AS rk FROM scored),
    tied AS (SELECT model, p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY model, p),
    steps AS (SELECT model, pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS said FROM tied
              WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
    areas AS (SELECT model, sum(CASE WHEN y = 1 THEN rk END) AS rs, CAST(sum(y) AS DOUBLE) AS np, CAST(sum(1 - y) AS DOUBLE) AS nn FROM ranked GROUP BY model),
    gains AS (SELECT model, sum(pos * tp / said) AS gain FROM steps GROUP BY model),
    parts AS (SELECT model, count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) AS tn, count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp,
      count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp,
      avg((p - y) * (p - y)) AS bs, avg(y) * (1 - avg(y)) AS chance FROM scored GROUP BY model)
    SELECT model, tn, fp, fn, tp, {r('bs', 'brier_score')}, {r('1 - bs / nullif(chance, 0)', 'brier_skill_score')},
      {r('CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2) / (np * nn) END', 'auroc')},
      {r('CASE WHEN np > 0 AND nn > 0 THEN gain / np END', 'auprc')}
    FROM parts JOIN areas USING (model) JOIN gains USING (model)""",
)
