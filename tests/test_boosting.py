"""Boosted trees against a plain single-machine version, and mutual information by neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, neighbours
from tidemark.operators.boosting import fit_boosted
from tidemark.operators.neighbours import digamma, neighbour_information

RNG = random.Random(9)


def plain_boosting(x, y, rounds, step, leaves, l2, least, bins):
    """One row at a time where it is cheap to, one node at a time, the best leaf first."""
    n = len(y)
    w = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))
    edges = []
    for column in x.T:
        ordered = np.sort(column)
        edges.append(sorted({ordered[max(0, math.ceil(k / bins * n) - 1)] for k in range(1, bins)}))
    b = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], 1)
    margin, total_gain = np.zeros(n), np.zeros(x.shape[1])

    def best(rows, g, h):
        whole, found = (g[rows].sum(), h[rows].sum()), None
        for f in range(x.shape[1]):
            for at in range(len(edges[f])):
                left = rows[b[rows, f] <= at]
                if len(left) < least or len(rows) - len(left) < least:
                    continue
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = whole[0] - gl, whole[1] - hl
                if min(hl, hr) < 1e-3:
                    continue
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - whole[0] ** 2 / (whole[1] + l2)
                if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-9)):
                    found = (gain, f, at)
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        front = [(np.arange(n), best(np.arange(n), g, h))]
        while len(front) < leaves and any(s for _, s in front):
            k = max((k for k in range(len(front)) if front[k][1]), key=lambda k: front[k][1][0])
            rows, (gain, f, at) = front.pop(k)
            total_gain[f] += gain
            for side in (rows[b[rows, f] <= at], rows[b[rows, f] > at]):
                front.append((side, best(side, g, h)))
        for rows, _ in front:
            margin[rows] -= step * g[rows].sum() / (h[rows].sum() + l2)
    return margin, total_gain / total_gain.sum()


def test_boosting_equals_a_single_machine_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 50)
    monkeypatch.setattr(boosting, "TREES_PER_REFRESH", 3)
    data = []
    for i in range(300):
        a, b, c = RNG.gauss(0, 1), RNG.randrange(4), RNG.random()
        data.append((i, int(a + 0.5 * b + RNG.gauss(0, 0.7) > 1.2), a, float(b), c, 1.0))
    df = spark.createDataFrame(data, "id long, y int, a double, b double, c double, one double").repartition(3)
    model = fit_boosted(df, ["a", "b", "c", "one"], "y", rounds=5, step=0.3, leaves=6, least_rows=5, bins=30)
    x, y = np.array([r[2:] for r in data]), np.array([r[1] for r in data])
    margin, shares = plain_boosting(x, y, 5, 0.3, 6, 0.01, 5, 30)
    found = {r["id"]: r for r in model.score(df, ["id", "y"]).collect()}
    assert max(abs(found[i]["margin"] - margin[i]) for i in range(300)) < 1e-9
    assert all(abs(found[i]["p"] - 1 / (1 + math.exp(-margin[i]))) < 1e-9 and found[i]["y"] == y[i] for i in range(300))
    importance = {r["feature"]: r["importance"] for r in model.importances(spark).collect()}
    assert all(importance[f] == pytest.approx(s, abs=1e-9) for f, s in zip(["a", "b", "c", "one"], shares))
    stronger = fit_boosted(df, ["a"], "y", rounds=1, step=1.0, leaves=2, least_rows=5, bins=30, l2=1e6)
    assert max(abs(r["margin"]) for r in stronger.score(df, []).collect()) < 1e-3


def test_boosting_of_one_class_and_of_constant_columns(spark):
    df = spark.createDataFrame([(1, 2.0)] * 30, "y int, a double")
    assert fit_boosted(df, ["a"], "y", rounds=2).score(df, ["y"]).first()["p"] > 0.99
    mixed = spark.createDataFrame([(k % 2, 2.0) for k in range(100)], "y int, a double")
    assert fit_boosted(mixed, ["a"], "y", rounds=2).score(mixed, ["y"]).first()["p"] == 0.5


def chain_of_rows(n=20_000, width=3, bins=128):
    """Rows whose splits all go down one side, while every other node has small gains of its own."""
    rng = np.random.default_rng(4)
    table = rng.integers(0, bins, (n, width))
    y = rng.random(n) < np.where(table[:, 0] % 2 == 0, 0.9, 0.1) * (table[:, 0] / bins) ** 3
    return table, 0.5 - y, np.full(n, 0.25)


def grown(table, g, h, bins, **options):
    """(tree, most nodes asked at once, most bytes held, passes) of a growth fed from rows in memory."""
    growth, most, held, passes = boosting.Growth(**options), 0, 0, 0
    while asked := growth.asked():
        at, found = boosting.leaf_of(growth.ahead.arrays(), table), {}
        for node in asked:
            rows = at == node
            found[node] = np.stack([
                np.stack([np.bincount(table[rows, f], w[rows], bins) for w in (g, h, np.ones(len(g)))], 1) for f in range(table.shape[1])
            ])
        growth.tell(found)
        known = [*growth.sums.values(), *[s.left if s.left.base is None else s.left.base for s in growth.splits.values() if s]]
        most, held, passes = max(most, len(asked)), max(held, sum(a.nbytes for a in known)), passes + 1
    return growth.tree(1.0)[0], most, held, passes


def test_growth_looks_at_no_more_nodes_than_there_are_leaves_left():
    """What the driver holds and asks for is bounded by leaves, features and bins, not by how deep the rows go."""
    table, g, h = chain_of_rows()
    tree, most, held, passes = grown(table, g, h, 128, leaves=12, l2=0.01, least_rows=20)
    assert most < 12 and held <= 3 * 12 * table.shape[1] * 128 * 3 * 8
    # The same leaves as by always taking the best leaf, with every sum found when it is wanted.
    front = [np.arange(len(g))]

    def best(rows):
        sums = np.stack([np.stack([np.bincount(table[rows, f], w[rows], 128) for w in (g, h, np.ones(len(g)))], 1) for f in range(3)])
        return boosting.best_split(sums, 0.01, 20)

    while len(front) < 12:
        found = [best(rows) for rows in front]
        k = max((k for k in range(len(front)) if found[k]), key=lambda k: found[k].gain)
        rows, split = front.pop(k), found[k]
        left = table[rows, split.feature] <= split.bin
        front += [rows[left], rows[~left]]
    leaf = boosting.leaf_of(tree.arrays(), table)
    assert passes <= 12
    assert sorted(sorted(r.tolist()) for r in front) == sorted(np.flatnonzero(leaf == n).tolist() for n in np.unique(leaf))


def brute_information(values, classes, neighbours=3):
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))
    pairs = [(v, c) for v, c in zip(values, classes) if v is not None and c is not None]
    sizes = {c: sum(d == c for _, d in pairs) for _, c in pairs}
    x = np.array([v for v, c in pairs if sizes[c] > 1])
    d = np.array([c for _, c in pairs if sizes[c] > 1])
    total = 0.0
    for i in range(len(x)):
        same = np.sort(np.abs(x[d == d[i]] - x[i]))
        k = min(neighbours, len(same) - 1)
        within = (np.abs(x - x[i]) < same[k]).sum() if same[k] > 0 else (x == x[i]).sum()
        total += psi(k) - psi(len(same)) - psi(within)
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("block", [50_000, 7])
def test_neighbour_information_equals_brute_force(spark, monkeypatch, without_broadcast, block):
    """Two thousand rows on a grid, so that distances are exact: many ties, a class of one row, a hot value, nulls."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    data = []
    for i in range(2000):
        y = RNG.choice([0, 0, 0, 1, 2]) if i else 9
        data.append((
            None if i % 50 == 7 else y, round((RNG.gauss(0, 1) + 3 * y) * 64) / 64, float(RNG.choice([1, 2, 2, 3])),
            RNG.randrange(1 << 20) / 1024 + 200 * y, 0.0 if i % 3 else RNG.randrange(64) / 64, None if i % 2 else -0.0,
        ))
    df = spark.createDataFrame(data, "y int, a double, b double, c double, d double, e double")
    found = {r[0]: r[1] for r in neighbour_information(df, ["a", "b", "c", "d", "e"], "y").collect()}
    for k, f in enumerate("abcde"):
        assert found[f] == pytest.approx(brute_information([r[k + 1] for r in data], [r[0] for r in data]), abs=1e-9), f
    assert found["a"] > 0.3 and [r[0] for r in neighbour_information(df, ["a", "b", "c"], "y", top=2).collect()] == ["a", "c"]


def test_digamma(spark):
    rows = spark.range(1, 2000, 13).select("id", digamma(F.col("id")).alias("d")).collect()
    assert all(abs(r["d"] - (-0.5772156649015329 + sum(1 / i for i in range(1, r["id"])))) < 1e-12 for r in rows)
