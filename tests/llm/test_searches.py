"""Searches of vectors against brute force, and how much work they do."""

import heapq
from types import SimpleNamespace

import numpy as np

from tidemark.llm import blocks, mtree, multi_index


def test_m_tree_holds_pages_against_all_their_questions(monkeypatch):
    """Repeated vectors and ids, ties; pages are visited for many questions at once, not once for each."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    vectors = np.floor(40 * np.vstack([centres[draw.integers(12, size=1000)] + 0.05 * draw.normal(size=(1000, 16)), draw.normal(size=(1000, 16))]))
    vectors[300:340] = vectors[7]
    ids = np.append(np.arange(1980), np.repeat([5, 1500], 10))
    visits = []

    def counted(queue):
        visits.append(1)
        return heapq.heappop(queue)

    monkeypatch.setattr(mtree, "heapq", SimpleNamespace(heappop=counted, heappush=heapq.heappush, heapreplace=heapq.heapreplace))
    tree = mtree.build_tree(ids, vectors, 5)
    chosen = np.flatnonzero(ids % 5 == 0)
    found = {k: (i.tolist(), s.tolist()) for k, i, s in mtree.search_tree(tree, {"ids": ids[chosen], "vectors": vectors[chosen]}, 5)}
    for k, row in enumerate(chosen.tolist()):
        scores = vectors @ vectors[row]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[row])[:5]
        assert found[k] == ([i for _, i in best], [-s for s, _ in best])
    leaves = tree["pages"][tree["pages"][:, 2] == 1]
    assert (leaves[:, 1] - leaves[:, 0]).mean() > mtree.PAGE / 8
    assert len(visits) < 4 * len(chosen)


def test_multi_index_is_one_index_however_rows_are_blocked(spark, monkeypatch):
    """Two lengths, repeated vectors and ids: the same rows from blocks of any size, scores and ranks as computed by hand."""
    draw = np.random.default_rng(4)
    made = [(i, draw.normal(size=24)) for i in range(900)]
    made += [(1000 + i, made[20][1]) for i in range(60)] + [(40, made[40][1]), (None, made[1][1])] + [(2000 + i, draw.normal(size=3)) for i in range(41)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in made], "vec_id long, embedding array<double>").repartition(3)
    found = []
    for size in (4096, 90):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
        monkeypatch.setattr(multi_index, "BLOCK_ROWS", size, raising=False)
        found.append(sorted(map(tuple, multi_index.approximate_nearest(frame, share=0.3).collect())))
    assert found[0] == found[1]
    vector = {i: v for i, v in made if i is not None}
    asked = [i for i, _ in made if i is not None and i % 20 == 0]
    assert len(found[0]) == 20 * len(asked)
    hits = {}
    for query, rank, i, score in found[0]:
        assert i != query and score == (vector[i] * vector[query]).sum()
        hits.setdefault(query, []).append((rank, -score, i))
    for query in set(asked):
        rows = sorted(hits[query])
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows) and [rows[0][0], rows[-1][0]] == [1, 20]
