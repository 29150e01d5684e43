"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import checkpointed, id_and_text, in_batches, small_or_not, text_or_empty

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
# Minima of the shingle values under 160 mixings, in bands of five, find candidates for a Jaccard similarity.
BANDS, BAND_ROWS = 32, 5
_draw = np.random.Generator(np.random.PCG64(SEED))
MIX_XOR, MIX_TIMES = _draw.integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64, endpoint=False)
MIX_TIMES = MIX_TIMES | np.uint64(1)
KEYS = ("row_id", "text_key", "row_key")
# Sets that may be similar are compared by chunks: of so many sets, but not more chunks than that unless they hold so many values.
CHUNK_SETS, MOST_CHUNKS, CHUNK_SHINGLES = 128, 16, 1 << 22
# Inside a task, sets and values are compared in blocks of so many.
BLOCK_SETS, BLOCK_VALUES = 256, 4096


def shingle_values(text: str, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words; of all words if there are fewer; empty without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts)
    )


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bits that over half of the shingles' XXH64 values have set; 0 without words."""
    values = shingle_values(text, width)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 16384):
        part = values[at : at + 16384].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) per row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return in_batches(id_and_text(docs, id_column)).mapInArrow(hashed, "doc_id long, fp long")


def _fingerprinted(rows: DataFrame, width: int) -> DataFrame:
    """row_id, text_key, row_key and the fingerprint as node."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in KEYS], pa.array(values.view(np.int64))], [*KEYS, "node"])

    return in_batches(rows).mapInArrow(hashed, "row_id long, text_key long, row_key long, node long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of which at least one avoids any ``radius`` bits.

    Bit i has a nonzero vector of radius + 1 binary digits; the mask of each nonzero vector v
    keeps the bits whose vector has an odd number of digits in common with v. Any ``radius``
    vectors leave some v that is even with all of them, so that mask drops all those bits.
    """
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(bits) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _long(value: int) -> Column:
    return F.lit(_signed(value)).cast("long")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``nodes.fp`` at distance 2 or less.

    ``nodes`` holds each fingerprint once. The covering tables put every linked pair into a
    common bucket. A bucket of two is compared directly. A larger one is resolved without
    pairs: two of its members within distance 2 differ in bits the mask dropped, so they meet
    in a value that differs from each of them in at most one dropped bit. Every member names
    these values (about 30); those that name a value lie within distance 2 of each other, and
    there are at most as many of them as values named, so all are linked to their smallest.
    """
    masks = covering_masks(RADIUS)
    tables = F.explode(F.array(*[
        F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for t, m in enumerate(masks)
    ]))
    placed = nodes.select("fp", tables.alias("_b")).select("_b.table", "_b.key", "fp")
    buckets = checkpointed(
        placed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    )
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")
    flips = F.array(*[
        F.array(*[_long(f) for f in [0, *[1 << i for i in range(BITS) if not m >> i & 1]]]) for m in masks
    ])
    members = placed.join(buckets.where("n > 2").select("table", "key"), ["table", "key"])
    named = members.select("table", "fp", F.explode(F.element_at(flips, F.col("table") + 1)).alias("_f"))
    meeting = named.select("table", F.col("fp").bitwiseXOR(F.col("_f")).alias("value"), "fp").groupBy("table", "value").agg(F.collect_set("fp").alias("fps"))
    stars = meeting.where(F.size("fps") > 1).select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node it is connected to.

    Alternates two steps until nothing changes: every node links its larger neighbours, then
    its smaller ones, to the smallest of them. Each round is written to the shared folder.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Documents with the same fingerprint are one node, whatever their number; nodes within
    two bits are linked, and component_id is the smallest doc_id reachable.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any
    other. Repeated rows each get a row; a null id is never the smallest unless the component
    has no other; an empty table gives no rows; other columns are not read.
    """
    found = checkpointed(fingerprints(docs, id_column))
    nodes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(nodes))
    classes = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(firsts, "root").select("fp", "component_id")
    return found.join(classes, "fp").select(
        F.col("doc_id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def set_and_bands(text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle values in order, and one value per band of their minima."""
    values = np.unique(shingle_values(text, width))
    if not len(values):
        return values, values
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        mixed = (values[None, at : at + 4096] ^ MIX_XOR[:, None]) * MIX_TIMES[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    bands = (least.reshape(BANDS, BAND_ROWS) * MIX_TIMES[:BAND_ROWS]).sum(axis=1, dtype=np.uint64)
    return values, bands


def _banded(rows: DataFrame, width: int) -> DataFrame:
    """row_id, text_key, row_key, node (digest of the shingle set), fp, n_shingles and bands of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*set_and_bands(t, width), fingerprint(t, width)) for t in batch.column("text").to_pylist()]
            columns = [
                *[batch.column(k) for k in KEYS],
                pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v, _, _ in found], pa.binary()),
                pa.array(np.array([f for _, _, f in found], np.uint64).view(np.int64)),
                pa.array([len(v) for v, _, _ in found], pa.int32()),
                pa.array([b.view(np.int64) for _, b, _ in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*KEYS, "node", "fp", "n_shingles", "bands"])

    fields = "row_id long, text_key long, row_key long, node binary, fp long, n_shingles int, bands array<long>"
    return in_batches(rows).mapInArrow(hashed, fields)


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(vertex, root) of every node that shares a candidate group with another; vertex is the XXH64 of the node.

    ``nodes`` has node, fp and bands. Two nodes are in one group if a chain of nodes leads from one
    to the other in which neighbours have fingerprints within two bits, as the covering masks tell
    without a miss, or share a band value. Buckets give one edge a member, never pairs. A clash
    of two hashes only makes a group larger.
    """
    prints = checkpointed(nodes.select("fp").distinct())
    near = checkpointed(components(links(prints)).select(F.col("node").alias("fp"), "root"))
    classed = nodes.select("node", "fp", "bands").join(small_or_not(near), "fp", "left")
    # The class of the fingerprint is one bucket more, after the bands.
    keys = F.concat("bands", F.array(F.coalesce("root", "fp")))
    placed = classed.select(F.xxhash64("node").alias("vertex"), F.posexplode(keys).alias("band", "value"))
    placed = placed.select("vertex", F.xxhash64("band", "value").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("vertex").alias("least")).where("_n > 1")
    members = placed.join(small_or_not(checkpointed(buckets.drop("_n"))), "bucket")
    return components(members.select(F.col("least").alias("u"), F.col("vertex").alias("v"))).withColumnRenamed("node", "vertex")


def _shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """node, root, chunks and the node's distinct shingle values, for rows of node, root, chunks and text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_values(t, width)) for t in batch.column("text").to_pylist()]
            kept = [batch.column(k) for k in ("node", "root", "chunks")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([v.view(np.int64) for v in sets], pa.list_(pa.int64()))], ["node", "root", "chunks", "shingles"]
            )

    return in_batches(rows).mapInArrow(hashed, "node binary, root long, chunks int, shingles array<long>")


def similar_blocks(left: list[np.ndarray], right: list[np.ndarray], similarity: float, same: bool = False) -> np.ndarray:
    """Pairs (i, j) of sets of the two lists, or of one list and itself, with at least that Jaccard similarity."""
    sizes = [np.array([len(v) for v in side]) for side in (left, right)]
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = int(sizes[0].sum())
    held = [np.zeros(len(values), bool), np.zeros(len(values), bool)]
    held[0][at[:split]], held[1][at[split:]] = True, True
    # Only values that two sets may share count; in a list and itself each is there twice.
    column = np.full(len(values), -1)
    both = held[0] & held[1] & (np.bincount(at.ravel(), minlength=len(values)) > (2 if same else 1))
    column[both] = np.arange(both.sum())
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    columns = [column[at[:split]], column[at[split:]]]
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(both.sum()), BLOCK_VALUES):
        dense = []
        for r, c, n in zip(rows, columns, sizes):
            inside = (c >= start) & (c < start + BLOCK_VALUES)
            part = np.zeros((len(n), min(BLOCK_VALUES, int(both.sum()) - start)), np.float32)
            part[r[inside], c[inside] - start] = 1
            dense.append(part)
        common += dense[0] @ dense[1].T
    whole = sizes[0][:, None] + sizes[1][None, :] - common.astype(np.float64)
    return np.argwhere(common.astype(np.float64) / np.maximum(whole, 1) >= similarity)


def _cell_links(table: pa.Table, similarity: float) -> pa.Table:
    """Edges that connect the similar nodes of one cell: at most one less than it has nodes."""
    nodes, chunk = table.column("node").to_pylist(), table.column("chunk").to_numpy()
    sets = [v.to_numpy() for v in (x.values for x in table.column("shingles"))]
    order = np.argsort(np.array([len(v) for v in sets]), kind="stable")
    sides = [order[chunk[order] == c] for c in np.unique(chunk)]
    one, other = sides[0], sides[-1]
    alone = table.column("first")[0].as_py() == table.column("second")[0].as_py()
    above, edges = list(range(len(nodes))), []

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    blocks = [range(0, len(side), BLOCK_SETS) for side in (one, other)] if alone or len(sides) > 1 else [[], []]
    for a in blocks[0]:
        left = one[a : a + BLOCK_SETS]
        for b in blocks[1]:
            right = other[b : b + BLOCK_SETS]
            # Both sides go by size, so far apart sizes are left out as blocks.
            low, high = (len(sets[left[0]]), len(sets[left[-1]])), (len(sets[right[0]]), len(sets[right[-1]]))
            if alone and b < a or low[1] < (similarity - 1e-9) * high[0] or high[1] < (similarity - 1e-9) * low[0]:
                continue
            pairs = similar_blocks([sets[k] for k in left], [sets[k] for k in right], similarity, alone and a == b)
            for i, j in pairs.tolist():
                u, v = top(int(left[i])), top(int(right[j]))
                if u != v:
                    above[v] = u
                    edges.append((nodes[left[i]], nodes[right[j]]))
    return pa.table([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["u", "v"])


def near_copy_links(nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root) of every node linked to another by shingle sets of Jaccard ``similarity`` or more.

    ``nodes`` holds each shingle set once: node, fp, n_shingles, bands, text_key; ``texts`` has
    text_key and text. Candidates are nodes whose fingerprints the covering masks find within
    two bits, and those that share a band value. A pair at similarity 0.8 shares none of the
    32 bands of 5 minima with probability (1 - 0.8 ** 5) ** 32 < 4e-6. Every link is checked on the sets.

    All pairs of a candidate group are compared, in cells: its nodes are dealt into chunks, and
    every two chunks meet once. So no task holds a large group, a set moves once for
    every chunk of its group, and a cell gives no more edges than connect its nodes.
    """
    groups = checkpointed(candidate_groups(nodes))
    named = nodes.select("node", "n_shingles", "text_key", F.xxhash64("node").alias("vertex"))
    grouped = checkpointed(named.join(small_or_not(groups), "vertex").drop("vertex"))
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_held")).where("_n > 1")
    least = F.least(F.lit(MOST_CHUNKS), F.ceil(F.col("_n") / CHUNK_SETS))
    chunks = sizes.select("root", F.greatest(F.ceil(F.col("_held") / CHUNK_SHINGLES), least).cast("int").alias("chunks"))
    wanted = checkpointed(grouped.join(small_or_not(checkpointed(chunks)), "root").drop("n_shingles"))
    # A node whose copies are many is read once.
    firsts = texts.join(small_or_not(wanted), "text_key").dropDuplicates(["node"])
    dealt = _shingle_sets(firsts, width).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("chunks")).cast("int"))
    cells = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "root", F.least("chunk", "_other").alias("first"), F.greatest("chunk", "_other").alias("second"), "chunk", "node", "shingles"
    )
    found = cells.groupBy("root", "first", "second").applyInArrow(lambda table: _cell_links(table, similarity), "u binary, v binary")
    return components(found)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, nulls last.

    Without ``similarity`` components are those of ``near_duplicates`` (fingerprints within
    two bits); with it, those of documents whose sets of ``width``-word shingles have at least
    that Jaccard similarity. Rows with the same id, or none, are told apart by hashes of their
    text and of all their columns; of equal rows one stays. Texts without words are alike.
    """
    keys = [F.col(id_column).cast("long").alias("row_id"), F.xxhash64(text_or_empty()).alias("text_key"), F.xxhash64(*docs.columns).alias("row_key")]
    rows = docs.select(*keys, text_or_empty().alias("text"))
    if similarity is None:
        found = checkpointed(_fingerprinted(rows, width))
        nodes = checkpointed(found.select("node").distinct())
        linked = components(links(nodes.withColumnRenamed("node", "fp")))
    else:
        found = checkpointed(_banded(rows, width))
        nodes = checkpointed(found.groupBy("node").agg(
            F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("fp", "n_shingles", "bands")]
        ))
        linked = near_copy_links(nodes, rows.select("text_key", "text"), width, similarity)
    placed = found.select(*KEYS, "node").join(linked, "node", "left").select(F.coalesce("root", "node").alias("root"), *KEYS)
    counted = checkpointed(placed.groupBy("root", *KEYS).agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("row_id").isNull().alias("_none"), *KEYS)
    first = counted.groupBy("root").agg(F.min(order).alias("_first")).select("root", "_first.*").drop("_none")
    told = [counted.root == first.root, *[counted[k].eqNullSafe(first[k]) for k in KEYS]]
    # Texts are not shuffled for rows that stay once: only rows to leave out and repeated ones are looked up.
    dropped = counted.join(first, told, "left_anti").select(*KEYS)
    again = counted.join(first, told, "left_semi").where("n > 1").select(*KEYS)
    named = docs.select("*", *keys)
    dropped, again = small_or_not(checkpointed(dropped.unionByName(again))), small_or_not(checkpointed(again))

    def same(other: DataFrame) -> list[Column]:
        return [named[k] == other[k] for k in ("row_key", "text_key")] + [named.row_id.eqNullSafe(other.row_id)]

    once = named.join(dropped, same(dropped), "left_anti")
    repeated = named.join(again, same(again), "left_semi").dropDuplicates(list(KEYS))
    return once.unionByName(repeated).select(*docs.columns)
