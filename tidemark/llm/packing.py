"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are packed, not documents: a pattern is a few lengths that fill one sequence, and
non-negative least squares over all patterns finds how often each has to be used so that
together they use up the histogram of lengths. What rounding leaves over is packed best-fit.
The plan is bounded by the capacity, whatever the number of documents; documents then take
their places by their rank among those of equal length.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.bpe import BYTE_PIECES, SPACE, Known, byte_symbols
from tidemark.llm.common import checkpointed, id_and_text, in_batches, running_starts

CAPACITY = 1024
END = 2
# Shares of the fitted repeats that are tried; the rest is packed best-fit.
SHARES = (1.0, 0.75, 0.5)


def _latin_pieces() -> re.Pattern:
    """The piece pattern for texts of code points up to U+00FF, with its classes spelled out."""
    kinds = {k: "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = SPACE.split("\\u")[0]
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{kinds['L']}]+| ?[{kinds['N']}]+| ?[^{space}{kinds['L']}{kinds['N']}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


class PieceEncoder:
    """Ids of the tokenizers library for a byte-level file, asked for once per distinct piece.

    The file's pre-tokeniser cuts a text into pieces that are encoded one by one, so ids of
    a known piece need no second call. Texts with a special string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.latin, self.any = _latin_pieces(), regex.compile(BYTE_PIECES)
        self.shown = str.maketrans({chr(byte): symbol for symbol, byte in byte_symbols().items()})
        self.known = Known(self._encoded)

    def _encoded(self, piece: str) -> bytes:
        """Ids of one piece, which the library's model wants spelled in printable bytes."""
        tokens = self.library.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.shown))
        return array("I", [t.id for t in tokens]).tobytes()

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any.findall(text)
        return self.latin.findall(text)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self._pieces(text))), np.uint32)


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary file."""
    return PieceEncoder(path)


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be below the capacity."""
    first = size if size <= capacity else size % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, size, capacity)]


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", digests: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece (from 0), start, length and its ids, or their checksum with ``digests``."""
    kind = pa.int64() if digests else pa.list_(pa.int32())
    column = "ids_crc32" if digests else "ids"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = piece_encoder(path), np.array([end], np.uint32)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([own.ids(text), last])
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((key, number, start, length, zlib.crc32(part.astype("<u4").tobytes()) if digests else part.astype(np.int32)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", column]
            )

    schema = f"doc_id long, piece int, start long, length long, {column} {'long' if digests else 'array<int>'}"
    return in_batches(id_and_text(docs, id_column)).mapInArrow(pieces, schema)


def patterns_of(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """All patterns of two or three of the given lengths that fill a sequence exactly.

    Rows are positions in ``lengths`` with ``len(lengths)`` for no document.
    """
    none = len(lengths)
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(none)
    first, second = np.triu_indices(none)
    rest = capacity - lengths[first] - lengths[second]
    pairs = rest == 0
    third = np.where(rest > 0, place[np.clip(rest, 0, capacity)], -1)
    triples = third >= second
    return np.concatenate([
        np.stack([first[pairs], second[pairs], np.full(pairs.sum(), none)], 1),
        np.stack([first[triples], second[triples], third[triples]], 1),
    ])


def fitted_repeats(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative least squares: repeats x with the patterns' total use closest to ``counts``.

    Active-set method: the pattern that would lower the error most joins the passive set, the
    unconstrained solution on that set is stepped to, and patterns it would make negative
    leave. The inverse of the set's Gram matrix is carried along, so a step is quadratic
    in the number of lengths. It ends when no pattern lowers the error of its lengths by half a
    document, so at most as many patterns are in use as there are lengths.
    """
    size = len(counts)
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    target = np.append(counts.astype(float), 0.0)
    inverse = np.zeros((size + 1, size + 1))
    chosen: list[int] = []
    barred = np.zeros(len(patterns), bool)

    def dense(pattern: np.ndarray) -> np.ndarray:
        return np.bincount(pattern, minlength=size + 1).astype(float) * (np.arange(size + 1) < size)

    def use(weights: np.ndarray, which: np.ndarray) -> np.ndarray:
        total = np.zeros(size + 1)
        for side in range(which.shape[1]):
            total += np.bincount(which[:, side], weights, size + 1)
        total[size] = 0.0
        return total

    for _ in range(6 * size):
        error = target - use(x[chosen], patterns[chosen]) if chosen else target
        gain = error[patterns].sum(1)
        gain[chosen], gain[barred] = -np.inf, -np.inf
        best = int(gain.argmax())
        if gain[best] <= 0.5:
            break
        column, n = dense(patterns[best]), len(chosen)
        cross = column[patterns[chosen]].sum(1) if n else np.zeros(0)
        lifted = inverse[:n, :n] @ cross
        rest = column @ column - cross @ lifted
        if n >= size or rest < 1e-7:
            barred[best] = True  # depends on the set until a pattern leaves it
            continue
        inverse[:n, :n] += np.outer(lifted, lifted) / rest
        inverse[:n, n] = inverse[n, :n] = -lifted / rest
        inverse[n, n] = 1.0 / rest
        chosen.append(best)
        while True:
            n = len(chosen)
            solution = inverse[:n, :n] @ target[patterns[chosen]].sum(1)
            if solution.min() > 0.0:
                x[chosen] = solution
                break
            now, falling = x[chosen], solution <= 0.0
            step = (now[falling] / np.maximum(now[falling] - solution[falling], 1e-300)).min()
            x[chosen] = now + step * (solution - now)
            leaving = [k for k in range(n) if falling[k] and x[chosen[k]] <= 1e-9]
            for k in reversed(leaving):
                n = len(chosen)
                x[chosen[k]] = 0.0
                order = [*range(k), n - 1, *range(k + 1, n - 1)] if k < n - 1 else list(range(n - 1))
                edge = inverse[:n, k].copy()
                smaller = inverse[:n, :n] - np.outer(edge, edge) / edge[k]
                inverse[: n - 1, : n - 1] = smaller[np.ix_(order, order)]
                chosen = [chosen[i] for i in order]
            barred[:] = False
            if not chosen or not leaving:
                break
    return x


def best_fit(left: np.ndarray, capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """(pattern, repeats) that use up ``left`` documents per length; equal sequences at once.

    A sequence starts with the longest document left and takes the longest that still fits,
    again and again; it is repeated while documents of all its lengths last.
    """
    left = left.copy()
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return
        pattern, space, at = [(top, 1)], capacity - top, min(top, capacity - top)
        if at == top and left[top] > 1:
            more = int(min(space // top, left[top] - 1))
            pattern, space = [(top, 1 + more)], space - more * top
        at = min(top - 1, space)
        while at:
            if left[at]:
                many = int(min(space // at, left[at]))
                if many:
                    pattern.append((at, many))
                    space -= many * at
            at = min(at - 1, space)
        repeats = int(min(left[length] // many for length, many in pattern))
        for length, many in pattern:
            left[length] -= repeats * many
        yield pattern, repeats


@dataclass(frozen=True)
class PackingPlan:
    """Places of the documents of each length, by their rank among them.

    ``keys`` are ``length << 40 | first rank`` in order; each row has its first sequence, its first
    offset and how many documents of that length one sequence takes there.
    """

    capacity: int
    first: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    many: np.ndarray
    total: int

    def places(self, lengths: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces, from their positions in the order of lengths."""
        rank = positions - self.first[lengths]
        row = np.searchsorted(self.keys, (lengths << 40) | rank, "right") - 1
        turn, place = np.divmod(rank - self.ranks[row], self.many[row])
        return self.sequences[row] + turn, self.offsets[row] + place * lengths


def _used_patterns(
    patterns: np.ndarray, repeats: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int
) -> list[tuple[list[tuple[int, int]], int]]:
    """(documents per length, repeats) of all sequences: the fitted patterns, then what is left best-fit."""
    left, used = counts.copy(), []
    for k in np.argsort(-repeats, kind="stable"):
        if not repeats[k]:
            break
        members = np.sort(lengths[patterns[k][patterns[k] < len(lengths)]])[::-1]
        many = Counter(members.tolist())
        turns = int(min(repeats[k], min(left[length] // n for length, n in many.items())))
        if turns:
            used.append((list(many.items()), turns))
            for length, n in many.items():
                left[length] -= turns * n
    return used + list(best_fit(left, capacity))


def packing_plan(counts: np.ndarray, capacity: int = CAPACITY) -> PackingPlan:
    """Plan for ``counts[length]`` pieces of each length up to ``capacity``.

    Repeats are rounded down. Patterns that are rounded to few repeats take short documents that the rest
    would need as filling, so smaller shares of the fit are tried too, and the fewest sequences win.
    """
    counts = counts.astype(np.int64)
    lengths = np.flatnonzero(counts[:capacity])
    patterns = patterns_of(lengths, capacity)
    repeats = fitted_repeats(patterns, counts[lengths])
    plans = [
        _used_patterns(patterns, np.floor(share * repeats + 1e-9).astype(np.int64), lengths, counts, capacity)
        for share in SHARES
    ]
    used = min(plans, key=lambda plan: sum(turns for _, turns in plan))
    rows, ranks, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, turns in used:
        offset = 0
        for length, n in pattern:
            rows.append((length << 40 | int(ranks[length]), int(ranks[length]), sequence, offset, n))
            ranks[length] += turns * n
            offset += n * length
        sequence += turns
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return PackingPlan(capacity, first, *(table[:, k].copy() for k in range(5)), sequence)


def packed(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end: int = END,
    id_column: str = "doc_id",
    digests: bool = False,
) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids, sequence_id, offset.

    A document is its token ids and then ``end``; only documents over ``capacity`` are cut, into
    pieces of ``capacity`` of which the first may be shorter. With ``digests`` a column
    ids_crc32 (ids as little-endian unsigned 32-bit numbers) stands in for ids. Sequences are
    gapless from offset 0 and never exceed ``capacity``.

    A null text counts as empty and is one token, ``end``. Repeated rows are packed each; a null id stays
    null; an empty table gives no rows; other columns are not read. Pieces of equal length
    are ranked by where they were written, over ranges sorted side by side, so a length
    that very many documents share is no single task. What reaches the driver is one count
    a length, at most ``capacity`` rows.
    """
    pieces = checkpointed(token_pieces(docs, path, capacity, end, id_column, digests))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = packing_plan(counts, capacity)
    one: Column = F.lit(1).cast("long")
    numbered = pieces.withColumn("_written", F.monotonically_increasing_id()).withColumn("_one", one)
    placed = running_starts(numbered, ["length", "_written"], "_one", "_position")
    kept = pieces.columns

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = plan.places(batch.column("length").to_numpy(), batch.column("_position").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                [*kept, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return in_batches(placed.select(*kept, "_position")).mapInArrow(assigned, f"{schema}, sequence_id bigint, offset bigint")
