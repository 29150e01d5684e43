"""Searches of a stated query set against blocks of all vectors, each block with its own index."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm.common import checkpointed, in_batches

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
# More blocks than this share slots of the join.
MOST_SLOTS = 4096

Index = dict[str, np.ndarray]


def pack(index: Index) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **index)
    return buffer.getvalue()


def unpack(data: bytes) -> Index:
    with np.load(io.BytesIO(data)) as stored:
        return {name: stored[name] for name in stored.files}


def usable(vectors: DataFrame, id_column: str, vector: str, zero: bool) -> DataFrame:
    """id and v (doubles) of rows that can take part: an id, components, none null or non-finite.

    ``zero`` tells whether vectors of only zeros are used.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & finite)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def in_blocks(rows: DataFrame, most: int, build: Callable[[np.ndarray, np.ndarray], Index]) -> DataFrame:
    """uid, dims, data: up to ``most`` rows of one partition and one length of vectors, built into an index."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[int, list[float]]]] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal number
            held = waiting.pop(dims)
            number += 1
            index = build(np.array([i for i, _ in held], np.int64), np.array([v for _, v in held], np.float64))
            return pa.RecordBatch.from_pylist([{"uid": f"{task}-{number}", "dims": dims, "data": pack(index)}], schema=layout)

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                held = waiting.setdefault(len(v), [])
                held.append((i, v))
                if len(held) >= most:
                    yield block(len(v))
        for dims in sorted(waiting):
            yield block(dims)

    layout = pa.schema([("uid", pa.string()), ("dims", pa.int32()), ("data", pa.binary())])
    return checkpointed(in_batches(rows.select("id", "v")).mapInArrow(packed, "uid string, dims int, data binary"))


def searched(
    queries: DataFrame, candidates: DataFrame, most: int, score_type: T.DataType,
    build: Callable[[np.ndarray, np.ndarray], Index],
    search: Callable[[Index, Index], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    ask: Callable[[np.ndarray, np.ndarray], Index] = lambda ids, v: {"ids": ids, "vectors": v},
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``most`` highest scores of every query over all blocks.

    Every block of queries meets every block of candidates once, by a join on the block's
    slot; a slot holds one block or a few. ``search`` gives, for each query of a block, at
    most ``most`` candidates of one candidate block, so what is merged per query is bounded
    by the number of blocks. ``ask`` makes a block of queries, with their ids and what else a
    search needs. Vectors meet only those of their own length.
    """
    data = in_blocks(candidates, BLOCK_ROWS, build)
    asked = in_blocks(queries.repartition(1 + queries.count() // QUERY_ROWS), QUERY_ROWS, ask)
    slots = max(1, min(data.count(), MOST_SLOTS))
    left = data.select("dims", F.pmod(F.hash("uid"), F.lit(slots)).alias("slot"), F.col("data"))
    right = asked.select("dims", F.col("uid").alias("asked"), F.col("data").alias("query"))
    right = right.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    pairs = left.repartition(slots, "slot", "dims").join(right.repartition(slots, "slot", "dims"), ["slot", "dims"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_uid, query, block in zip(*[batch.column(c).to_pylist() for c in ("asked", "query", "data")]):
                questions = unpack(query)
                keys, own, ids, scores = [], [], [], []
                for k, vec_ids, values in search(unpack(block), questions):
                    keys += [f"{asked_uid}-{k}"] * len(vec_ids)
                    own += [int(questions["ids"][k])] * len(vec_ids)
                    ids += vec_ids.tolist()
                    scores += values.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(own, pa.int64()), pa.array(ids, pa.int64()),
                     pa.array(scores, pa.int64() if score_type == T.LongType() else pa.float64())],
                    ["key", "query_id", "vec_id", "score"],
                )

    rows = in_batches(pairs.select("asked", "query", "data"), rows=8)
    rows = rows.mapInArrow(found, f"key string, query_id long, vec_id long, score {score_type.simpleString()}")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def best_of(asked: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best per question, questions rising, ties to smaller ids."""
    order = np.lexsort((ids, -scores, asked))
    starts = np.flatnonzero(np.diff(asked[order], prepend=-1))
    turn = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[turn < most]


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component, so that all have the same length and the nearest has the largest product."""
    norms = (vectors**2).sum(axis=1)
    return np.hstack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0.0))[:, None]])
