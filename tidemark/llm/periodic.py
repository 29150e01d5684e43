"""Periodic runs of words: stretches that repeat with a short period at least three times.

A stretch of length L with smallest period q, L at least 3q, is a repeat of L - q words with
itself, q words on, that no word to its left or right extends: a maximal pair whose distance is at most half
of what it repeats. So runs are read from the maximal pairs of a text's suffixes. They are
enumerated bottom-up over the tree of LCP intervals; each interval carries its positions in
lists by the word to their left, and only positions of different lists pair up.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text, in_batches

# Fixed value: words are what stands between blanks of these kinds.
WORDS = re.compile("[^\x20\x09-\x0d]+")
LEAST = 24
REPEATS = 3
# Texts are analysed together up to this many words; a longer text is analysed alone.
WORDS_AT_ONCE = 200_000
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """For each key, how many keys are smaller."""
    order = np.argsort(keys, kind="stable")
    ordered, at = keys[order], np.arange(len(keys))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    return rank


def _doubled(rank: np.ndarray, chosen: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Keys of ``2 * width`` words at the chosen positions; a text's end is the smallest word."""
    after = chosen + width
    inside = after < ends[chosen]
    following = np.where(inside, rank[np.minimum(after, len(rank) - 1)] + 1, 0)
    return rank[chosen] * (len(rank) + 1) + following


def rank_levels(words: np.ndarray, text: np.ndarray, ends: np.ndarray, full: int) -> list[np.ndarray]:
    """Ranks of the 2**k words from every position on, for k = 0, 1, ... until all differ.

    Equal ranks mean equal words inside one text. Beyond ``full`` words only positions that are not alone
    yet are ranked on: each keeps its place among the others, so unranked ones stay right.
    """
    at = np.arange(len(words))
    levels = [_ranks(text * (int(words.max()) + 1) + words)]
    width = 1
    while width < full:
        levels.append(_ranks(_doubled(levels[-1], at, ends, width)))
        width *= 2
    open_ = at
    while True:
        rank = levels[-1]
        open_ = open_[np.bincount(rank, minlength=len(rank))[rank[open_]] > 1]
        if not len(open_):
            return levels
        keys = _doubled(rank, open_, ends, width)
        order = np.argsort(keys, kind="stable")
        ordered, base, turn = keys[order], rank[open_][order], np.arange(len(open_))
        fresh, other = np.ones(len(open_), bool), np.ones(len(open_), bool)
        fresh[1:], other[1:] = ordered[1:] != ordered[:-1], base[1:] != base[:-1]
        refined = rank.copy()
        refined[open_[order]] = base + np.maximum.accumulate(np.where(fresh, turn, 0)) - np.maximum.accumulate(np.where(other, turn, 0))
        levels.append(refined)
        width *= 2


def repeating_texts(words: np.ndarray, text: np.ndarray, ends: np.ndarray, full: int) -> np.ndarray:
    """Numbers of the texts in which some ``full`` words (at most four are looked at) occur twice."""
    rank = _ranks(text * (int(words.max()) + 1) + words)
    width, at = 1, np.arange(len(words))
    while width < min(full, 4):
        keys = _doubled(rank, at, ends, width)
        rank = _ranks(keys)
        width *= 2
    return np.unique(text[np.bincount(rank, minlength=len(rank))[rank] > 1])


def shared_words(levels: Sequence[np.ndarray], one: np.ndarray, other: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes at ``one`` and ``other`` (of the same text) have in common."""
    one, other = one.copy(), other.copy()
    limit = ends[np.maximum(one, other)] if len(one) else one
    total = np.zeros(len(one), np.int64)
    last = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = np.maximum(one, other) + step <= limit
        same = fits & (levels[k][np.minimum(one, last)] == levels[k][np.minimum(other, last)])
        total += same * step
        one += same * step
        other += same * step
    return total


class Interval:
    """Positions of one LCP interval, in order, and by the word to their left."""

    __slots__ = ("positions", "by_left")

    def __init__(self, position: int, left: int):
        self.positions = [position]
        self.by_left = {left: [position]}

    def joined(self, other: Interval, shared: int, left: Sequence[int], found: list[tuple[int, int, int]]) -> Interval:
        """Both as one; pairs across them that ``shared`` words on differ, and to the left too, are found.

        Only distances up to half of ``shared`` are looked at. Of the two ways to find a
        position's partners, through its window or through the other lists, the shorter is taken.
        """
        large, small = (self, other) if len(self.positions) >= len(other.positions) else (other, self)
        reach = shared // (REPEATS - 1)
        for here in small.positions:
            own = left[here]
            low = bisect_left(large.positions, here - reach)
            high = bisect_right(large.positions, here + reach, low)
            if high - low <= len(large.by_left):
                partners = [p for p in large.positions[low:high] if left[p] != own]
            else:
                partners = []
                for word, listed in large.by_left.items():
                    if word != own:
                        partners += listed[bisect_left(listed, here - reach) : bisect_right(listed, here + reach)]
            for there in partners:
                found.append((min(here, there), abs(here - there), shared))
        for here in small.positions:
            insort(large.positions, here)
        for word, listed in small.by_left.items():
            known = large.by_left.setdefault(word, [])
            for here in listed:
                insort(known, here)
        return large


def maximal_pairs(order: Sequence[int], shared: Sequence[int], left: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, distance, length) of the maximal pairs with a distance of at most half their length.

    ``order`` holds suffixes in order, ``shared[k]`` what suffix k has in common with the one before it.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, Interval]] = []
    for k in range(1, len(order) + 1):
        next_shared = shared[k] if k < len(order) else 0
        node = Interval(order[k - 1], left[order[k - 1]])
        while stack and stack[-1][0] > next_shared:
            depth, upper = stack.pop()
            node = upper.joined(node, depth, left, found)
        if next_shared:
            if stack and stack[-1][0] == next_shared:
                depth, upper = stack.pop()
                node = upper.joined(node, depth, left, found)
            stack.append((next_shared, node))
    return found


def runs_of(texts: Sequence[Sequence[str]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, a list of words, by start and then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not starts[-1]:
        return out
    numbers: dict[str, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(starts[-1]))
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(starts[1:], sizes)
    # What a run repeats is at least this long, as its period is at most a third of it.
    floor = -(-least * (REPEATS - 1) // REPEATS)
    full = 1 << (floor.bit_length() - 1)
    rest = repeating_texts(words, text, ends, full)
    if len(rest) < len(texts):
        for number, runs in zip(rest.tolist(), runs_of([texts[k] for k in rest], least) if len(rest) else []):
            out[number] = runs
        return out
    levels = rank_levels(words, text, ends, full)
    deep = full.bit_length() - 1
    alike = np.bincount(levels[deep], minlength=len(words))
    kept = np.flatnonzero(alike[levels[deep]] > 1)
    if not len(kept):
        return out
    # Positions of one repeated group of ``full`` words: worth a walk only if two of them are near enough.
    group = levels[deep][kept]
    order = kept[np.argsort(levels[-1][kept], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    same = levels[deep][order[1:]] == levels[deep][order[:-1]]
    pairs = np.flatnonzero(same) + 1
    shared[pairs] = shared_words(levels, order[pairs - 1], order[pairs], ends)
    by_place = np.lexsort((kept, group))
    gaps = np.diff(kept[by_place])
    gaps[group[by_place][1:] != group[by_place][:-1]] = np.iinfo(np.int64).max
    top = int(group.max()) + 1
    nearest = np.full(top, np.iinfo(np.int64).max)
    np.minimum.at(nearest, group[by_place][1:], gaps)
    deepest = np.zeros(top, np.int64)
    np.maximum.at(deepest, levels[deep][order], shared)
    hopeful = nearest <= deepest // (REPEATS - 1)
    use = hopeful[levels[deep][order]]
    order, shared = order[use], shared[use]
    if not len(order):
        return out
    left = np.where(np.arange(len(words)) == starts[text], -1, np.roll(words, 1))
    periods: dict[tuple[int, int], int] = {}
    for start, distance, length in maximal_pairs(order.tolist(), shared.tolist(), left.tolist()):
        if distance + length >= least:
            key = (start, distance + length)
            periods[key] = min(distance, periods.get(key, distance))
    for (start, length), period in sorted(periods.items(), key=lambda kv: (kv[0][0], kv[1])):
        number = int(text[start])
        out[number].append((start - int(starts[number]), length, period))
    return out


def collapsed(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words without those that any run repeats: what lies in a run after its first period."""
    if not runs:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period, in words), collapsed.

    Runs are ordered by start, then period; ``collapsed`` is the text's words without the repetitions, joined by
    one blank. A null or empty text has no words, no runs and an empty ``collapsed``. Repeated
    rows are analysed each; a null id stays null; an empty table gives no rows; other
    columns are not read. Whole texts are analysed; a very long one alone, in memory in
    proportion to its words times the logarithm of its longest repetition.
    """

    def analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                words, held, first = [], 0, at
                while at < len(texts) and (not words or held + len(texts[at]) // 2 <= WORDS_AT_ONCE):
                    words.append(WORDS.findall(texts[at]))
                    held += len(words[-1])
                    at += 1
                found = runs_of(words, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, at - first),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], RUNS),
                        pa.array([" ".join(collapsed(w, r)) for w, r in zip(words, found)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return in_batches(id_and_text(docs, id_column)).mapInArrow(
        analysed, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
