"""Near copies: candidates by covering masks and bands, compared in cells."""

import random

import numpy as np

from tidemark.llm import simhash


def test_covering_masks_put_close_fingerprints_into_one_group(spark):
    # Bands that no two nodes share: only the fingerprints can bring them together.
    prints = [0b1111, 0b1100, 0b1100 ^ 1 << 40, 1 << 62, 1 << 62, -1]
    nodes = [(bytes([i]), f, [100 * i + b for b in range(3)]) for i, f in enumerate(prints)]
    df = spark.createDataFrame(nodes, "node binary, fp long, bands array<long>").selectExpr("*", "xxhash64(node) AS vertex")
    groups = simhash.candidate_groups(df).join(df, "vertex").collect()
    root = {r["node"][0]: r["root"] for r in groups}
    assert root[0] == root[1] == root[2] and root[3] == root[4] and root[0] != root[3] and 5 not in root


def test_blocks_find_all_similar_pairs():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**62, 5000).astype(np.uint64)
    sets = [np.unique(np.r_[base[: draw.integers(1, 5000)], draw.integers(0, 2**62, 300).astype(np.uint64)]) for _ in range(20)]
    sets += [np.zeros(0, np.uint64), base[:4], base[:5], base[:1]]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
    wanted = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if jaccard(a, b) >= 0.8}
    assert (21, 22) in wanted
    assert set(map(tuple, simhash.similar_blocks(sets, sets, 0.8).tolist())) == wanted
    alone = {(i, j) for i, j in simhash.similar_blocks(sets, sets, 0.8, same=True).tolist() if i != j}
    assert alone == {(i, j) for i, j in wanted if i != j}


def test_cells_lose_no_link_and_give_a_forest(spark, monkeypatch):
    # Small chunks, so that links cross them.
    monkeypatch.setattr(simhash, "CHUNK_SETS", 8)
    draw = random.Random(2)
    base, texts = [f"w{draw.randrange(10**6)}" for _ in range(200)], []
    for _ in range(90):
        base[draw.randrange(200)] = f"w{draw.randrange(10**6)}"
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.deduplicated(docs, width=5, similarity=0.8).collect()] == [0]
