"""Gradient boosting of histogram trees with an L2 term on leaf values, log loss and class weights.

Rows are binned once and kept as blocks of small numbers. What a tree needs from them are sums of
gradients, of second derivatives and of rows per (node, feature, bin): one aggregate over all blocks for a
whole front of nodes, combined in each task before it is shuffled. Splits are chosen from these
sums, whose number is bounded by leaves, features and bins, whatever the number of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators.prep import to_long
from tidemark.operators.selection import quantile_columns
from tidemark.operators.splits import balanced_weights
from tidemark.session import materialise, small_frame, spread

BINS = 255
ROWS_PER_BLOCK = 8192
# Trees whose sums are added to the blocks' margins together. Every pass over the blocks walks down the trees not added yet.
TREES_PER_REFRESH = 5
# Partitions of dealt rows that are walked over in one task, where that leaves no core idle: every task of a pass sends all its sums, and the driver keeps a record of it.
PARTS_PER_TASK = 8
# A side with less curvature than this is not split off.
LEAST_CURVATURE = 1e-3


@dataclass
class Tree:
    """A binary tree over bins: a row goes left where its bin of ``feature`` is at most ``bin``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, at
        self.left[node], self.right[node] = len(self.left), len(self.left) + 1
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.bin, self.left, self.right, self.value))


def leaf_of(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """Leaf of every row of ``bins`` (rows by features)."""
    feature, at, left, right, _ = tree
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        rows = rows[left[node[rows]] >= 0]
        here = node[rows]
        node[rows] = np.where(bins[rows, feature[here]] <= at[here], left[here], right[here])
    return node


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    left: np.ndarray  # sums of gradients, curvature and rows that go left


def best_split(sums: np.ndarray, l2: float, least_rows: int) -> Split | None:
    """Best split of a node from its sums (feature, bin, 3); ties go to the first feature and bin."""
    total = sums[0].sum(0)
    left = np.cumsum(sums, 1)[:, :-1]
    right = total - left
    allowed = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows)
    allowed &= (left[..., 1] >= LEAST_CURVATURE) & (right[..., 1] >= LEAST_CURVATURE)
    if not allowed.any():
        return None
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, score(left) + score(right) - score(total), -np.inf)
    # Equal up to rounding counts as equal, so that the order of summation decides nothing.
    best = gain.max()
    if not best > 1e-12:
        return None
    feature, at = np.unravel_index(int((gain >= best - 1e-9 * abs(best)).argmax()), gain.shape)
    # A copy: a part of ``left`` would keep all of it.
    return Split(float(best), int(feature), int(at), left[feature, at].copy())


class Growth:
    """Best-first growth of one tree; a round asks for the sums of all nodes that may be split next.

    Which node is split next depends on gains alone. So nodes are looked at ahead, and the tree takes from them in the
    order of their gains. Those that cannot come in time are not looked beyond: a round asks for fewer nodes than the tree
    may have leaves, and sums are held for one round.
    """

    def __init__(self, leaves: int, l2: float, least_rows: int):
        self.leaves, self.l2, self.least = leaves, l2, least_rows
        self.ahead = Tree()  # all nodes looked at
        self.splits: dict[int, Split | None] = {}
        self.sums: dict[int, np.ndarray] = {}  # of nodes that were asked for or divided in this round
        self.taken: list[int] = []
        self.front: set[int] = {0}

    def asked(self) -> list[int]:
        """Nodes of ``ahead`` whose sums are needed now; none once the tree is complete."""
        if not self.splits:
            return [0]
        while len(self.front) < self.leaves:
            open_ = [n for n in self.front if self.splits.get(n) is not None]
            if not open_:
                return []
            node = max(open_, key=lambda n: (self.splits[n].gain, -n))
            if self.ahead.left[node] < 0:
                break
            self.taken.append(node)
            self.front.remove(node)
            self.front.update((self.ahead.left[node], self.ahead.right[node]))
        else:
            return []
        # Looking at all of them costs one front more of sums, and saves a pass over the rows for each step further down.
        divided = self._may_be_taken()
        self.sums = {n: self.sums[n] for n in divided}
        needed = []
        for n in divided:
            split = self.splits[n]
            children = self.ahead.split(n, split.feature, split.bin)
            whole = self.sums[n][0].sum(0)
            sizes = (split.left, whole - split.left)
            for child, s in zip(children, sizes):
                self.ahead.value[child] = -s[0] / (s[1] + self.l2)
                self.splits[child] = None
            small = min((0, 1), key=lambda k: sizes[k][2])
            if sizes[1 - small][2] >= 2 * self.least:
                needed.append(children[small])
        return needed if needed else self.asked()

    def _may_be_taken(self) -> list[int]:
        """Nodes not looked beyond that are reached before the leaves run out, in the order of their numbers.

        The tree is grown on as if nothing unknown had a gain. Nodes still unknown can only come between, never change the
        order of those known, so a node that is not reached now is never split. At most as many are as leaves are left.
        """
        ahead, room, reached = self.ahead, self.leaves - len(self.front), []
        open_ = [(-self.splits[n].gain, n) for n in self.front if self.splits.get(n) is not None]
        heapq.heapify(open_)
        while open_ and room:
            node = heapq.heappop(open_)[1]
            room -= 1
            if ahead.left[node] < 0:
                reached.append(node)
                continue
            for child in (ahead.left[node], ahead.right[node]):
                if self.splits[child] is not None:
                    heapq.heappush(open_, (-self.splits[child].gain, child))
        return sorted(reached)

    def tell(self, found: dict[int, np.ndarray]) -> None:
        for node, sums in found.items():
            if node == 0:
                total = sums[0].sum(0)
                self.ahead.value[0] = -total[0] / (total[1] + self.l2)
                self._known(0, sums)
                continue
            parent = next(p for p in self.sums if node in (self.ahead.left[p], self.ahead.right[p]))
            other = self.ahead.left[parent] + self.ahead.right[parent] - node
            self._known(node, sums)
            self._known(other, self.sums[parent] - sums)

    def _known(self, node: int, sums: np.ndarray) -> None:
        self.sums[node] = sums
        self.splits[node] = best_split(sums, self.l2, self.least)

    def tree(self, step: float) -> tuple[Tree, dict[int, float]]:
        """The tree of the splits taken, with leaf values times ``step``, and the gain of each feature."""
        tree, gains, number = Tree(), {}, {0: 0}
        for node in self.taken:
            split = self.splits[node]
            kids = tree.split(number[node], split.feature, split.bin)
            number[self.ahead.left[node]], number[self.ahead.right[node]] = kids
            gains[split.feature] = gains.get(split.feature, 0.0) + split.gain
        for node in self.front:
            tree.value[number[node]] = step * self.ahead.value[node]
        return tree, gains


BLOCK = "y binary, w binary, bins binary, margin binary"


def _blocks(train: DataFrame, features: Sequence[str], label: str, edges: Sequence[np.ndarray], start: float, weights: dict[int, float]) -> DataFrame:
    """Rows as blocks of binned features, labels, weights and margins, which take so little room that a task holds many."""
    parts = train.rdd.getNumPartitions()
    tasks = max(-(-parts // PARTS_PER_TASK), min(parts, train.sparkSession.sparkContext.defaultParallelism))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(at, ROWS_PER_BLOCK)
                y = part.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                w = np.where(y == 1, weights.get(1, 0.0), weights.get(0, 0.0))
                bins = np.stack([
                    np.searchsorted(e, part.column(k + 1).to_numpy(zero_copy_only=False)) for k, e in enumerate(edges)
                ], 1).astype(np.uint8)
                row = [[c.tobytes()] for c in (y, w, bins, np.full(len(y), start))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in row], ["y", "w", "bins", "margin"])

    columns = train.select(F.col(label).cast("int"), *[F.col(f).cast("double") for f in features])
    return materialise(columns.mapInArrow(packed, BLOCK).coalesce(tasks))


def _decoded(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for y, w, bins, margin in zip(*[batch.column(c).to_pylist() for c in ("y", "w", "bins", "margin")]):
        yield np.frombuffer(y), np.frombuffer(w), np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(margin)


def _refreshed(blocks: DataFrame, trees: Sequence[tuple[np.ndarray, ...]], width: int) -> DataFrame:
    """Blocks with the trees' values added to the margins."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [m + sum(t[4][leaf_of(t, b)] for t in trees) for _, _, b, m in _decoded(batch, width)]
            kept = [batch.column(c) for c in ("y", "w", "bins")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([m.tobytes() for m in margins], pa.binary())], ["y", "w", "bins", "margin"])

    return materialise(blocks.mapInArrow(added, BLOCK))


def _node_sums(
    blocks: DataFrame, trees: Sequence[tuple[np.ndarray, ...]], ahead: Tree, asked: Sequence[int], width: int, bins_each: int
) -> dict[int, np.ndarray]:
    """Sums (feature, bin, 3) of the asked nodes of the tree that is growing."""
    growing = ahead.arrays()
    turn = np.full(len(growing[0]), -1)
    turn[list(asked)] = np.arange(len(asked))
    size = len(asked) * width * bins_each

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, size))
        for batch in batches:
            for y, w, bins, margin in _decoded(batch, width):
                line = margin + sum(t[4][leaf_of(t, bins)] for t in trees)
                which = turn[leaf_of(growing, bins)]
                rows = which >= 0
                p = 1.0 / (1.0 + np.exp(-line[rows]))
                g, h = w[rows] * (p - y[rows]), w[rows] * p * (1.0 - p)
                slot = ((which[rows, None] * width + np.arange(width)) * bins_each + bins[rows]).ravel()
                for k, part in enumerate((g, h, np.ones(len(g)))):
                    total[k] += np.bincount(slot, np.repeat(part, width), size)
        used = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[k][used]) for k in range(3)]], ["slot", "g", "h", "n"])

    parts = blocks.mapInArrow(summed, "slot long, g double, h double, n double")
    found = parts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    sums = np.zeros((size, 3))
    sums[found.column("slot").to_numpy()] = np.stack([found.column(c).to_numpy() for c in ("g", "h", "n")], 1)
    return dict(zip(asked, sums.reshape(len(asked), width, bins_each, 3)))


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted sum of trees with the columns it reads and their bin edges."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    start: float
    trees: tuple[tuple[np.ndarray, ...], ...]
    gains: tuple[float, ...]

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., p, margin): probability of class 1 and the decision value."""
        kept = df.select(*keep)
        names, edges, start, trees = kept.columns, self.edges, self.start, self.trees

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.columns[len(names):]
                bins = np.stack([np.searchsorted(e, v.to_numpy(zero_copy_only=False)) for e, v in zip(edges, values)], 1)
                margin = np.full(len(bins), start)
                for tree in trees:
                    margin += tree[4][leaf_of(tree, bins)]
                p = 1.0 / (1.0 + np.exp(-margin))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p), pa.array(margin)], [*names, "p", "margin"])

        schema = T.StructType([*kept.schema.fields, T.StructField("p", T.DoubleType()), T.StructField("margin", T.DoubleType())])
        columns = [F.col(f).cast("double").alias(f"__x{k}") for k, f in enumerate(self.features)]
        return df.select(*keep, *columns).mapInArrow(scored, schema)

    def importances(self, spark) -> DataFrame:
        """(feature, importance): share of the total gain, highest first."""
        whole = sum(self.gains) or 1.0
        rows = [(f, g / whole) for f, g in zip(self.features, self.gains)]
        schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
        return small_frame(spark, rows, schema).orderBy(F.desc("importance"), "feature")


def bin_edges(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper ends of all bins but the last: exact quantiles of each column, equal ones once."""
    asked = [k / bins for k in range(1, bins)]
    found = quantile_columns(to_long(train, features), ["feature"], "value", asked, interpolate=False).collect()
    by_feature = {row["feature"]: np.unique(row["quantiles"]) for row in found}
    return [by_feature.get(f, np.zeros(0)) for f in features]


def fit_boosted(
    train: DataFrame, features: Sequence[str], label: str, seed: int = 42, rounds: int = 300, step: float = 0.05,
    leaves: int = 31, l2: float = 0.01, least_rows: int = 20, bins: int = BINS,
) -> BoostedTrees:
    """Boosted trees on balanced classes; leaf values are ``-G / (H + l2)`` times ``step``.

    Trees grow best-first to ``leaves`` leaves of at least ``least_rows`` rows. Features must not be null. Nothing is
    drawn at random, so ``seed`` changes nothing. The margin starts at the log odds of the weighted classes.
    """
    features = list(features)
    train = spread(train)
    weights = {row[label]: row["weight"] for row in balanced_weights(train, label).collect()}
    edges = bin_edges(train, features, bins)
    # With both classes balanced the weighted odds are even; one class alone has bounded odds.
    start = 0.0 if len(weights) > 1 else float(np.log(1e6)) * (1 if 1 in weights else -1)
    blocks, width, used = _blocks(train, features, label, edges, start, weights), len(features), max([len(e) for e in edges], default=0) + 1
    trees: list[tuple[np.ndarray, ...]] = []
    fresh: list[tuple[np.ndarray, ...]] = []
    gains = np.zeros(width)
    for _ in range(rounds if len(weights) > 1 and width else 0):
        growth = Growth(leaves, l2, least_rows)
        while asked := growth.asked():
            growth.tell(_node_sums(blocks, fresh, growth.ahead, asked, width, used))
        tree, gained = growth.tree(step)
        for feature, gain in gained.items():
            gains[feature] += gain
        fresh.append(tree.arrays())
        trees.append(fresh[-1])
        if len(fresh) == TREES_PER_REFRESH:
            blocks, fresh = _refreshed(blocks, fresh, width), []
    return BoostedTrees(tuple(features), tuple(edges), start, tuple(trees), tuple(gains))
