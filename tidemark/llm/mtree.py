"""Exact top-k inner products by best-first search of M-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, types as T

from tidemark.llm.blocks import Index, best_of, lifted, searched, usable

PAGE = 48
SCALE = 256
# Distances are compared with this relative slack, so that rounding never drops a tie.
SLACK = 1e-9


def build_tree(ids: np.ndarray, vectors: np.ndarray, most: int) -> Index:
    """A paged M-tree over the distinct vectors.

    Pages are rows of ``pages`` (first entry, end, whether a leaf). An entry has a vector
    (``points``), its distance to the pivot of its page's parent entry (``parent``), and in
    inner pages the page below it (``child``) with the radius that covers all of it. Of equal
    vectors the ids are listed, smallest first, as far as a query can need them: ``most``
    besides the query's own, each repeated id at most ``most`` times.
    """
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    listed, starts = [], [0]
    for members in np.split(ids[order], np.cumsum(np.bincount(group.ravel()))[:-1]):
        values, counts = np.unique(members, return_counts=True)
        listed.append(np.repeat(values[: most + 1], np.minimum(counts[: most + 1], most)))
        starts.append(starts[-1] + len(listed[-1]))
    points = lifted(distinct)
    pages: list[list[int]] = []
    entry: list[int] = []
    parent: list[float] = []
    child: list[int] = []
    radius: list[float] = []
    # Pages are filled from the root down; a page's entries lie side by side.
    waiting = [(np.arange(len(points)), -1)]
    while waiting:
        members, above = waiting.pop()
        number = len(pages)
        pivot = points[entry[above]] if above >= 0 else None
        if above >= 0:
            child[above] = number
        leaf = len(members) <= PAGE
        # No more parts than fill half of their pages, so that a leaf is worth a visit.
        parts = len(members) if leaf else min(PAGE, -(-2 * len(members) // PAGE))
        chosen = members if leaf else members[np.linspace(0, len(members) - 1, parts).astype(int)]
        pages.append([len(entry), len(entry) + len(chosen), int(leaf)])
        gaps = np.zeros(len(chosen)) if pivot is None else np.sqrt(((points[chosen] - pivot) ** 2).sum(axis=1))
        first = len(entry)
        entry += chosen.tolist()
        parent += gaps.tolist()
        child += [-1] * len(chosen)
        radius += [0.0] * len(chosen)
        if leaf:
            continue
        own = points[members]
        squares = (own**2).sum(axis=1)[:, None] - 2 * own @ points[chosen].T + (points[chosen] ** 2).sum(axis=1)[None, :]
        # A pivot belongs to its own part, so every part is smaller than the whole.
        squares[np.searchsorted(members, chosen), np.arange(len(chosen))] = -np.inf
        part = squares.argmin(axis=1)
        for k in range(len(chosen)):
            inside = members[part == k]
            spread = np.sqrt(((points[inside] - points[chosen[k]]) ** 2).sum(axis=1))
            radius[first + k] = float(spread.max())
            waiting.append((inside, first + k))
    return {
        "points": points, "ids": np.concatenate(listed), "starts": np.array(starts), "pages": np.array(pages),
        "entry": np.array(entry), "parent": np.array(parent), "child": np.array(child), "radius": np.array(radius),
    }


def search_tree(tree: Index, questions: Index, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each question its ``most`` best (ids, scores) of the tree, ties to smaller ids.

    Questions that reach the same page are held against it together. Each first goes down to
    the leaf nearest to it, so that it has a limit; then pages are taken by rising bound, and
    a question leaves a page whose bound is beyond its own limit.
    """
    points, ids, starts, pages = tree["points"], tree["ids"], tree["starts"], tree["pages"]
    entry, parent, child, radius = tree["entry"], tree["parent"], tree["child"], tree["radius"]
    own, vectors = questions["ids"], questions["vectors"]
    total = len(own)
    reach = (vectors**2).sum(axis=1) + (points**2).sum(axis=1).max()
    slack = SLACK * (reach + 1)
    limit, worst = np.full(total, np.inf), np.full(total, -np.inf)
    # The best found so far: question, score and id, by question.
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    everyone = np.arange(total)
    # Later visits than the first way down, lowest bound, number of the entry; page, questions, bounds, distances to its pivot.
    queue: list[tuple] = [(0, 0.0, 0, 0, everyone, np.zeros(total), None)]
    number = 0
    while queue:
        later, _, _, page, active, bounds, gap = heapq.heappop(queue)
        still = bounds <= limit[active]
        active, gap = active[still], gap if gap is None else gap[still]
        first, end, leaf = pages[page].tolist()
        at = np.arange(first, end)
        if gap is not None:
            # The triangle inequality over the parent's distance spares most computations.
            open_ = np.abs(gap[:, None] - parent[first:end]) - radius[first:end] <= limit[active][:, None]
            active, at = active[open_.any(axis=1)], at[open_.any(axis=0)]
        if not len(active) or not len(at):
            continue
        products = vectors[active] @ points[entry[at], :-1].T
        if leaf:
            which, where = np.nonzero(products >= worst[active][:, None])
            held = entry[at[where]]
            copies = starts[held + 1] - starts[held]
            listed = np.arange(copies.sum()) + np.repeat(starts[held] - np.cumsum(copies) + copies, copies)
            asked, found = np.repeat(active[which], copies), ids[listed]
            hits = np.rint(products[which, where])
            if len(hits) and np.abs(hits).max() >= 2.0**63:
                raise OverflowError("an inner product is too large for a long")
            scores = np.repeat(hits, copies).astype(np.int64)
            other = found != own[asked]
            if not other.any():
                continue
            asked, scores, found = asked[other], scores[other], found[other]
            changed = np.zeros(total, bool)
            changed[asked] = True
            old = changed[best[0]]
            mine = [np.concatenate([b[old], n]) for b, n in zip(best, (asked, scores, found))]
            kept = best_of(*mine, most)
            mine = [m[kept] for m in mine]
            # A question with ``most`` answers has a limit, the score of the last of them.
            last = np.flatnonzero(np.bincount(mine[0], minlength=total) >= most)
            lowest = mine[1][np.searchsorted(mine[0], last, side="right") - 1]
            worst[last] = lowest
            limit[last] = np.sqrt(np.maximum(reach[last] - 2 * lowest, 0.0) + slack[last]) + np.sqrt(slack[last]) * 1e-3
            best = tuple(np.concatenate([b[~old], m]) for b, m in zip(best, mine))
            continue
        gaps = np.sqrt(np.maximum(reach[active][:, None] - 2 * products, 0.0))
        bounds = np.maximum(gaps - radius[at], 0.0)
        hopeful = bounds <= limit[active][:, None]
        nearest = np.zeros_like(hopeful)
        if not later:
            nearest[np.arange(len(active)), gaps.argmin(axis=1)] = True
        for turn, chosen in ((0, nearest & hopeful), (1, hopeful & ~nearest)):
            for j in np.flatnonzero(chosen.any(axis=0)).tolist():
                k = np.flatnonzero(chosen[:, j])
                number += 1
                item = (turn, float(bounds[k, j].min()), number, int(child[at[j]]), active[k], bounds[k, j], gaps[k, j])
                heapq.heappush(queue, item)
    kept = best_of(*best, most)
    asked, scores, found = (b[kept] for b in best)
    edges = np.searchsorted(asked, np.arange(total + 1))
    for k in everyone.tolist():
        yield k, found[edges[k] : edges[k + 1]], scores[edges[k] : edges[k + 1]]


def exact_top(
    vectors: DataFrame, every: int = 50, most: int = 5, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: exact top ``most`` integer inner products.

    Components x become floor(256 * x); queries are the rows whose id is divisible by
    ``every``, candidates all rows but those with the query's own id. Ties go to the smaller
    id. Vectors that are null, empty or hold null or non-finite components, and rows without
    an id, take no part. A repeated row is a candidate and a query each time. Vectors of
    different lengths do not meet. Products are exact below 2**52. An empty table gives no
    rows; other columns are not read.
    """
    rows = usable(vectors, id_column, vector, zero=True)
    rows = rows.selectExpr("id", f"transform(v, x -> CAST(floor({SCALE} * x) AS double)) AS v")
    return searched(
        rows.where(f"id % {every} = 0"), rows, most, T.LongType(),
        lambda ids, v: build_tree(ids, v, most), lambda tree, questions: search_tree(tree, questions, most),
    )
