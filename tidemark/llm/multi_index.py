"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.blocks import BLOCK_ROWS, Index, best_of, searched, usable
from tidemark.llm.common import checkpointed, in_batches

# Centroids of each half; the index has their square of cells.
CENTROIDS = 32
# The centroids are fitted on about this many rows, drawn by a hash of the id.
SAMPLE_ROWS = 8192
# A query reranks the entries of the nearest cells until it has this share of all rows.
SHARE = 0.6
# Inside a task, so many queries are held against a block, and so many found products computed anew, at once.
ASKED_ROWS = 128
EXACT_ROWS = 65_536
# Bounds are lowered by this relative slack, so that rounding never closes a cell or drops a tie.
SLACK = 1e-9
Halves = tuple[np.ndarray, np.ndarray]


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)


def fit_centres(rows: DataFrame, seed: int = 42) -> dict[int, Halves]:
    """Centroids of both halves for each length of vectors, from a bounded sample."""
    total = max(1, rows.count())
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit((SAMPLE_ROWS << 30) // total)).limit(4 * SAMPLE_ROWS)
    lengths: dict[int, list] = {}
    for row in sorted((r["id"], r["v"]) for r in sample.collect()):
        lengths.setdefault(len(row[1]), []).append(row[1])
    out = {}
    for dims, held in lengths.items():
        points = np.array(held)
        out[dims] = (k_means(points[:, : dims // 2], CENTROIDS, seed), k_means(points[:, dims // 2 :], CENTROIDS, seed))
    return out


def halves_of(vectors: np.ndarray, centres: dict[int, Halves]) -> Halves:
    """The centroids for these vectors; a length that the sample missed has one cell."""
    dims = vectors.shape[1]
    return centres.get(dims) or (np.zeros((1, dims // 2)), np.zeros((1, dims - dims // 2)))


def cells_of(vectors: np.ndarray, centres: dict[int, Halves]) -> np.ndarray:
    first, second = halves_of(vectors, centres)
    cut = first.shape[1]
    return nearest(vectors[:, :cut], first) * len(second) + nearest(vectors[:, cut:], second)


def with_cells(rows: DataFrame, centres: dict[int, Halves]) -> DataFrame:
    """id, v, dims and cell, computed once."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                held = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                cell = cells_of(held.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), centres)
                columns = [held.column("id"), held.column("v"), pa.array(np.full(len(cell), dims, np.int32)), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "dims", "cell"])

    return checkpointed(in_batches(rows.select("id", "v")).mapInArrow(placed, "id long, v array<double>, dims int, cell int"))


def rows_of_cells(celled: DataFrame, centres: dict[int, Halves]) -> dict[int, np.ndarray]:
    """For each length that has centroids, the rows of every cell: at most the square of the centroids are collected."""
    out = {dims: np.zeros(len(first) * len(second), np.int64) for dims, (first, second) in centres.items()}
    for r in celled.where(F.col("dims").isin(list(out))).groupBy("dims", "cell").count().collect():
        out[r["dims"]][r["cell"]] = r["count"]
    return out


def build_cells(ids: np.ndarray, vectors: np.ndarray, centres: dict[int, Halves]) -> Index:
    """Rows by cell: the cells that have any, and where each starts."""
    first, second = halves_of(vectors, centres)
    cell = cells_of(vectors, centres)
    order = np.lexsort((ids, cell))
    cells, starts = np.unique(cell[order], return_index=True)
    return {
        "ids": ids[order], "vectors": vectors[order], "cells": cells, "starts": np.append(starts, len(ids)),
        "first": first, "second": second,
    }


def nearest_cells(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by rising sum of their distances, from a heap of the next pairs."""
    by_a, by_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    heap = [(a[by_a[0]] + b[by_b[0]], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield by_a[i], by_b[j]
        # Each pair has one predecessor: a row is entered at its first column.
        if j + 1 < len(by_b):
            heapq.heappush(heap, (a[by_a[i]] + b[by_b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(by_a):
            heapq.heappush(heap, (a[by_a[i + 1]] + b[by_b[0]], i + 1, 0))


def build_questions(
    ids: np.ndarray, vectors: np.ndarray, centres: dict[int, Halves], sizes: dict[int, np.ndarray], most: int, share: float
) -> Index:
    """Queries, each with the nearness of the last cell that it visits of all cells of the table.

    Cells are taken by falling nearness until ``share`` of all rows is held. Nearness is the
    product, so a centroid is the farther the smaller its product is.
    """
    first, second = halves_of(vectors, centres)
    cut, size = first.shape[1], sizes.get(vectors.shape[1])
    last = np.full(len(ids), -np.inf)
    if size is not None:
        a, b, held_of = vectors[:, :cut] @ first.T, vectors[:, cut:] @ second.T, size.tolist()
        wanted = max(4 * most, int(share * sum(held_of)))
        for k in range(len(ids)):
            held = 0
            for i, j in nearest_cells(-a[k], -b[k]):
                held += held_of[i * len(second) + j]
                if held >= wanted:
                    last[k] = a[k, i] + b[k, j]
                    break
    return {"ids": ids, "vectors": vectors, "last": last - SLACK * (1 + np.abs(last))}


def search_cells(index: Index, questions: Index, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each question the ``most`` best (ids, scores) of the cells of a block that it visits."""
    ids, vectors, cells, starts = index["ids"], index["vectors"], index["cells"], index["starts"].tolist()
    first, second = index["first"], index["second"]
    cut, longest = first.shape[1], np.sqrt((vectors**2).sum(axis=1).max())
    for begin in range(0, len(questions["ids"]), ASKED_ROWS):
        own, asked, last = (questions[name][begin : begin + ASKED_ROWS] for name in ("ids", "vectors", "last"))
        nearness = (asked[:, :cut] @ first.T)[:, cells // len(second)] + (asked[:, cut:] @ second.T)[:, cells % len(second)]
        visited = nearness >= last[:, None]
        products = np.full((len(own), len(ids)), -np.inf)
        for c in np.flatnonzero(visited.any(axis=0)).tolist():
            here = np.flatnonzero(visited[:, c])
            products[here, starts[c] : starts[c + 1]] = asked[here] @ vectors[starts[c] : starts[c + 1]].T
        held = np.repeat(visited, np.diff(starts), axis=1) & (own[:, None] != ids[None, :])
        products[~held | np.isnan(products)] = -np.inf
        worst = np.full(len(own), -np.inf)
        if len(ids) > most:
            worst = np.partition(products, -most, axis=1)[:, -most] - SLACK * np.sqrt((asked**2).sum(axis=1)) * longest
        which, where = np.nonzero(held & ~(products < worst[:, None]))
        parts = [slice(k, k + EXACT_ROWS) for k in range(0, len(which), EXACT_ROWS)]
        scores = np.concatenate([(vectors[where[p]] * asked[which[p]]).sum(axis=1) for p in parts] or [np.empty(0)])
        best = best_of(which, scores, ids[where], most)
        which, where, scores = which[best], where[best], scores[best]
        edges = np.searchsorted(which, np.arange(len(own) + 1)).tolist()
        for k in range(len(own)):
            at = slice(edges[k], edges[k + 1])
            yield begin + k, ids[where[at]], scores[at]


def approximate_nearest(
    vectors: DataFrame, every: int = 20, most: int = 20, share: float = SHARE, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``most`` largest inner products found.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but those
    with the query's own id; every row is indexed, in one index of cells over the whole table. Scores are exact products in double
    precision; ties go to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, take no part. A repeated row is a
    candidate and a query each time. Vectors of different lengths do not meet. An empty table
    gives no rows; other columns are not read.
    """
    rows = usable(vectors, id_column, vector, zero=False)
    centres = fit_centres(rows)
    celled = with_cells(rows, centres)
    sizes = rows_of_cells(celled, centres)
    # Neighbouring cells share a block; a cell with many rows is cut by their ids. Ranges are uneven, so less than a block each.
    # A session that deals them finer still gets whole blocks, as what a query gathers grows with the blocks.
    parts = 1 + 4 * celled.count() // (3 * BLOCK_ROWS)
    dealt = celled.repartitionByRange(parts, "dims", "cell", "id").coalesce(parts)
    return searched(
        celled.where(f"id % {every} = 0"), dealt, most, T.DoubleType(),
        lambda ids, v: build_cells(ids, v, centres), lambda index, questions: search_cells(index, questions, most),
        lambda ids, v: build_questions(ids, v, centres, sizes, most, share),
    )
