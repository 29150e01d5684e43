"""Shards from a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import BROADCAST_ROWS, running_starts, unfolded
from tidemark.session import small_frame

# 2**31 - 1, a prime: products of two residues stay below 2**62.
PRIME = 2_147_483_647
ROUNDS = 8
TERMS = 4


class Permutation:
    """A seeded permutation of the numbers 0 .. size - 1.

    A number is split into two digits of a mixed radix ``left`` x ``right`` that covers
    ``size`` with fewer than ``left`` numbers to spare. Each round adds a keyed cubic
    polynomial (modulo a prime) of one digit to the other. A number that lands outside is
    permuted again until it is inside (cycle walking). Walks run through spare numbers
    only, of which there are about the square root of ``size``, so the end of the walk from
    each of them is computed once, ahead of the rows.
    """

    def __init__(self, size: int, seed: int = 42, rounds: int = ROUNDS):
        if size < 0 or size >= PRIME**2:
            raise ValueError(f"size out of range: {size}")
        self.size = size
        self.left = max(1, _ceil_root(size))
        self.right = max(1, -(-size // self.left))
        draw = random.Random(f"{seed}-{rounds}")
        self.keys = [[draw.randrange(1, PRIME) for _ in range(TERMS)] for _ in range(rounds)]

    def once(self, numbers: np.ndarray) -> np.ndarray:
        """One pass over numbers of the whole radix range."""
        left, right = numbers // self.right, numbers % self.right
        for turn, keys in enumerate(self.keys):
            if turn % 2 == 0:
                left = (left + _poly(right, keys)) % self.left
            else:
                right = (right + _poly(left, keys)) % self.right
        return left * self.right + right

    def apply(self, numbers: np.ndarray) -> np.ndarray:
        """The permutation on the driver, for computing single places."""
        found = self.once(np.asarray(numbers, dtype=np.int64))
        while (outside := found >= self.size).any():
            found[outside] = self.once(found[outside])
        return found

    def spares(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers outside and where a walk from each of them ends; about a square root of ``size``."""
        if not self.size:
            # Without numbers inside no walk ends, and there is none to begin.
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        outside = np.arange(self.size, self.left * self.right, dtype=np.int64)
        return outside, self.apply(outside)

    def columns(self, df: DataFrame, number: str, name: str) -> DataFrame:
        """Adds the permuted ``number`` as ``name``, from built-in expressions and a join on the walks.

        One pass leaves few numbers outside; where each of those ends is looked up.
        """
        df = self._once(df.withColumn(name, F.col(number)), name)
        outside, ends = self.spares()
        if not len(outside):
            return df
        schema = T.StructType([T.StructField(name, T.LongType()), T.StructField("_end", T.LongType())])
        walks = small_frame(df.sparkSession, zip(outside.tolist(), ends.tolist()), schema)
        # A hint only within the usual bound; beyond it, adaptive execution chooses.
        walks = F.broadcast(walks) if len(outside) <= BROADCAST_ROWS else walks
        return df.join(walks, name, "left").withColumn(name, F.coalesce("_end", name)).drop("_end")

    def _once(self, df: DataFrame, name: str) -> DataFrame:
        df = df.withColumns({
            "_l": F.expr(f"{name} div {self.right}L"), "_r": F.expr(f"{name} % {self.right}L"),
        })
        for turn, keys in enumerate(self.keys):
            to, of, modulus = ("_l", "_r", self.left) if turn % 2 == 0 else ("_r", "_l", self.right)
            df = df.withColumn(to, (F.col(to) + _poly_column(F.col(of), keys)) % F.lit(modulus))
        return df.withColumn(name, F.col("_l") * F.lit(self.right) + F.col("_r")).drop("_l", "_r")


def _ceil_root(n: int) -> int:
    root = int(np.sqrt(n))
    while root * root < n:
        root += 1
    while root and (root - 1) ** 2 >= n:
        root -= 1
    return root


def _poly(x: np.ndarray, keys: list[int]) -> np.ndarray:
    total = np.full_like(x, keys[0])
    for key in keys[1:]:
        total = (total * x + key) % PRIME
    return total


def _poly_column(x: Column, keys: list[int]) -> Column:
    total = F.lit(keys[0]).cast("long")
    for key in keys[1:]:
        total = (total * x + F.lit(key)) % F.lit(PRIME)
    return total


def shard_plan(docs: DataFrame, shards: int = 16, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """One row per document: its shard and its slot in that shard.

    Documents are numbered in the order of (id, checksum, size); the permuted number
    divided by ``shards`` leaves the shard as remainder and the slot as quotient. So shard
    sizes differ by one row at most, slots have no gaps, and both can be computed from
    the number alone (``Permutation.apply``) without the table.

    Columns: id_column, size (UTF-8 bytes + 1), text_crc32, row_number, shard, slot.

    Nulls: a null id sorts first, a null text has size 1 and the checksum of the empty
    text. Rows equal in id, size and checksum are counted before the shuffle and get
    neighbouring numbers, so any of them may take any of their places. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = docs.select(
        F.col(id_column).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    groups = digest.groupBy("_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    placed = running_starts(groups, ["_id", "text_crc32", "size"], "_copies", "_start")
    total = placed.agg(F.sum("_copies")).first()[0] or 0
    rows = unfolded(placed, "_copies", "_copy").withColumn("row_number", F.col("_start") + F.col("_copy"))
    rows = Permutation(total, seed).columns(rows, "row_number", "_place")
    return rows.select(
        F.col("_id").alias(id_column), "size", "text_crc32", "row_number",
        F.expr(f"CAST(_place % {shards}L AS int)").alias("shard"),
        F.expr(f"_place div {shards}L").alias("slot"),
    )
