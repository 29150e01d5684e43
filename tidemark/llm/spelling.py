"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped under their commonest form.

One error leaves the first or the second half of a word untouched. So each word is dealt to
blocks by the halves its variants may share with it, and each block answers with a
bidirectional FM-index over its words, with delimiters between them: the shared half is
matched exactly, up to the delimiter outside it, then the match is extended across the other half with one error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import checkpointed, id_and_text, in_batches, small_or_not

# Fixed value: what counts as a run of letters.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST = 5
RAREST = 3
# Postings of an index block, on average; a shared half with more than these is dealt out over blocks of its own.
BLOCK = 40_000
# Counts that a task holds before it hands them on.
HELD = 300_000


def vocabulary(
    docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, spoilt: int | None = None, id_column: str = "doc_id"
) -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, of ``shortest`` code points and ``rarest`` occurrences or more.

    With ``spoilt`` a run loses a letter where that number divides the checksum of
    ``<doc_id>:<run>``; the checksum also tells which letter. A null text has no words; repeated rows count each; a
    null id reads as empty; an empty table has no words. Counts are added up in each task before they are shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                # In UTF-8 only A-Z are bytes that lower() changes.
                runs = Counter(LETTERS.findall(text.encode("utf-8", "replace").lower().decode()))
                base = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in runs.items():
                    if len(run) < shortest:
                        continue
                    if spoilt is not None and not (h := zlib.crc32(run.encode(), base)) % spoilt:
                        cut = h % len(run)
                        run = run[:cut] + run[cut + 1 :]
                        if len(run) < shortest:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield flushed()
        yield flushed()

    counts = in_batches(id_and_text(docs, id_column)).mapInArrow(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


class RankTable:
    """Ranks in a sequence of small numbers, by one bit of them at a time (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.zeros, self.split, at = [], [], symbols
        self.first = np.zeros(kinds, np.int64)
        for bit in reversed(range(max(1, int(kinds - 1).bit_length()))):
            ones = (at >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - ones)]))
            self.split.append(int(self.zeros[-1][-1]))
            at = np.concatenate([at[ones == 0], at[ones == 1]])
        self.depth = len(self.zeros)
        # Where each symbol's entries begin after the last bit, and where they begin in sorted order.
        places = np.full(kinds, -1)
        seen, where = np.unique(at, return_index=True)
        places[seen] = where
        counts = np.bincount(symbols, minlength=kinds)
        self.shift = np.concatenate([[0], np.cumsum(counts)[:-1]]) - places

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval of the sorted rotations after one more symbol, and how many entries of the old one are smaller."""
        smaller = np.zeros(len(low), np.int64)
        for level in range(self.depth):
            one = (symbol >> (self.depth - 1 - level)) & 1 == 1
            zeros, split = self.zeros[level], self.split[level]
            z_low, z_high = zeros[low], zeros[high]
            smaller += np.where(one, z_high - z_low, 0)
            low = np.where(one, split + low - z_low, z_low)
            high = np.where(one, split + high - z_high, z_high)
        shift = self.shift[symbol]
        return low + shift, high + shift, smaller

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All symbols that occur in each interval: (interval, symbol, low, high after that symbol)."""
        which, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for zeros, split in zip(self.zeros, self.split):
            z_low, z_high = zeros[low], zeros[high]
            o_low, o_high = split + low - z_low, split + high - z_high
            with_zero, with_one = z_high > z_low, o_high > o_low
            which = np.concatenate([which[with_zero], which[with_one]])
            symbol = np.concatenate([2 * symbol[with_zero], 2 * symbol[with_one] + 1])
            low = np.concatenate([z_low[with_zero], o_low[with_one]])
            high = np.concatenate([z_high[with_zero], o_high[with_one]])
        return which, symbol, low + self.shift[symbol], high + self.shift[symbol]


def _rotations(text: np.ndarray, kinds: int) -> np.ndarray:
    """Starts of all rotations of ``text`` in sorted order; as many symbols as one number holds are compared at first, then twice as many each time."""
    bits = max(1, int(kinds - 1).bit_length())
    key, width = np.zeros(len(text), np.int64), 62 // bits
    for k in range(width):
        key = (key << bits) | np.roll(text, -k)
    while True:
        kinds, rank = np.unique(key, return_inverse=True)
        if len(kinds) == len(text):
            return np.argsort(rank)
        key = rank * len(text) + np.roll(rank, -width)
        width *= 2


class BidirectionalIndex:
    """FM-index of distinct words with a delimiter before each, and one of the same text reversed.

    An interval of the one stands for the same occurrences as one of the other, so a match can be
    extended to the left by the first and then to the right by the second.
    """

    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sizes = np.array([len(w) for w in words], np.int64)
        alphabet, codes = np.unique(letters, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        text = np.zeros(len(letters) + len(words), np.int64)
        inside = np.ones(len(text), bool)
        inside[self.starts] = False
        text[inside] = codes + 1
        self.text, self.sizes, kinds = text, sizes, len(alphabet) + 1
        forward = _rotations(text, kinds)
        self.left = RankTable(text[forward - 1], kinds)
        # Reversed, every word stands before its delimiter; turned by one, after it.
        turned = np.roll(text[::-1], 1)
        backward = _rotations(turned, kinds)
        self.right = RankTable(turned[backward - 1], kinds)
        self.size = len(text)
        # Rotations of the reversed text that begin with a delimiter are its first ones; the word
        # whose reversal follows it ends where the delimiter stands in the text.
        delimiters = backward[: len(words)]
        ends = (len(text) - delimiters) % len(text)
        order = np.argsort(self.starts)
        following = np.searchsorted(self.starts[order], np.where(ends == 0, len(text), ends))
        self.word_at = order[(following - 1) % len(words)]

    def anchored(self, query: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals (reversed text) of the delimiter and the first ``exact`` symbols of each queried word.

        They are matched to the left, from their last symbol to the delimiter.
        """
        low, high = np.zeros(len(query), np.int64), np.full(len(query), self.size)
        other = low.copy()
        for back in range(int(exact.max(initial=-1)) + 1):
            going = np.flatnonzero(back <= exact)
            place = exact[going] - back  # 0 is the delimiter before the word
            symbol = self.text[self.starts[query[going]] + place]
            new_low, new_high, smaller = self.left.step(low[going], high[going], symbol)
            other[going] += smaller
            low[going], high[going] = new_low, new_high
        return other, other + high - low

    def one_error(self, query: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): all words that start with the first ``exact`` symbols of the queried
        word and differ from it by exactly one inserted, deleted or replaced symbol after them.

        The error-free match goes on letter by letter; at each letter it branches into all
        errors, and the branches are matched to the closing delimiter without further ones.
        """
        low, high = self.anchored(query, exact)
        asking, at = np.arange(len(query)), exact.astype(np.int64)
        sizes = self.sizes[query]
        begin = self.starts[query] + 1
        pool = [np.zeros(0, np.int64)] * 4
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(asking) or len(pool[0]):
            # Branches with their one error go one symbol on, the delimiter at the end of the word.
            who, place, p_low, p_high = pool
            done = place == sizes[who]
            symbol = np.where(done, 0, self.text[np.minimum(begin[who] + place, self.size - 1)])
            p_low, p_high, _ = self.right.step(p_low, p_high, symbol)
            found = p_high > p_low
            hits.append((who[found & done], p_low[found & done]))
            on = found & ~done
            pool = [who[on], place[on] + 1, p_low[on], p_high[on]]
            if not len(asking):
                continue
            more = at < sizes[asking]
            here = np.where(more, self.text[np.minimum(begin[asking] + at, self.size - 1)], 0)
            second = np.where(at + 1 < sizes[asking], self.text[np.minimum(begin[asking] + at + 1, self.size - 1)], 0)
            # Of equal letters in a row the last is deleted, and inserted after the others.
            deleted = more & (here != second)
            which, symbol, b_low, b_high = self.right.branches(low, high)
            same = symbol == here[which]
            other = ~same & (symbol != 0)
            replaced = other & more[which]
            spawned = [
                [asking[deleted], at[deleted] + 1, low[deleted], high[deleted]],
                [asking[which[other]], at[which[other]], b_low[other], b_high[other]],
                [asking[which[replaced]], at[which[replaced]] + 1, b_low[replaced], b_high[replaced]],
            ]
            pool = [np.concatenate(column) for column in zip(pool, *spawned)]
            exactly = same & more[which]
            asking, at, low, high = asking[which[exactly]], at[which[exactly]] + 1, b_low[exactly], b_high[exactly]
        return np.concatenate([h[0] for h in hits]), self.word_at[np.concatenate([h[1] for h in hits])]


def near_in_block(rows: pa.Table) -> pa.Table:
    """Per asking word of one block: how many words in it are near, and the commonest of them.

    Rows have word, n, flipped (the shared half is the second: words are turned round), exact (code points of the
    shared half), member, asks.
    """
    names, flipped = rows.column("word").to_pylist(), rows.column("flipped")[0].as_py()
    words = sorted(set(names))
    number = {w: k for k, w in enumerate(words)}
    place = np.array([number[w] for w in names])
    counts = np.zeros(len(words), np.int64)
    counts[place] = rows.column("n").to_numpy()
    member = np.zeros(len(words), bool)
    member[place[rows.column("member").to_numpy()]] = True
    asks = rows.column("asks").to_numpy()
    query, exact = place[asks], rows.column("exact").to_numpy()[asks].astype(np.int64)
    index = BidirectionalIndex([w[::-1] for w in words] if flipped else words)
    who, near = index.one_error(query, exact)
    real = member[near]
    if flipped:
        # Pairs that share the first half too belong to the other search.
        halves = [words[q][: len(words[q]) - e] for q, e in zip(query, exact)]
        real &= np.fromiter((not words[c].startswith(halves[w]) for w, c in zip(who, near)), bool, len(who))
    who, near = who[real], near[real]
    best = np.full(len(query), -1)
    # Words are in code-point order, so the first of the commonest is the smallest.
    order = np.lexsort((near, -counts[near], who))
    leading, first = np.unique(who[order], return_index=True)
    best[leading] = near[order][first]
    return pa.table({
        "word": pa.array([words[q] for q in query], pa.string()),
        "n": pa.array(counts[query], pa.int64()),
        "n_near": pa.array(np.bincount(who, minlength=len(query)), pa.int64()),
        "best": pa.array([words[b] if b >= 0 else None for b in best], pa.string()),
        "best_n": pa.array([int(counts[b]) if b >= 0 else None for b in best], pa.int64()),
    })


def _postings(words: DataFrame) -> DataFrame:
    """Each word under every half that a word near it may leave untouched, marked where it is its own."""
    size = F.length("word")

    def halves(flipped: bool) -> Column:
        half = (lambda m: F.ceil(m / 2)) if flipped else (lambda m: F.floor(m / 2))
        # Lengths one below and one above give at most two halves.
        all_ = F.array_distinct(F.array(*[half(size + d).cast("int") for d in (-1, 0, 1)]))
        own = half(size).cast("int")
        return F.transform(
            F.filter(all_, lambda h: h <= size),
            lambda h: F.struct(F.lit(flipped).alias("flipped"), h.alias("exact"), (h == own).alias("asks")),
        )

    listed = words.select("word", "n", F.inline(F.concat(halves(False), halves(True))))
    shared = F.when(F.col("flipped"), F.right("word", F.col("exact"))).otherwise(F.left("word", F.col("exact")))
    return listed.withColumn("shared", shared)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, best, best_n) of distinct words: how many are near, and the commonest (ties: smallest).

    ``words`` are checkpointed (word, n). A shared half lies in one block; one that more than ``block`` words have is
    split over blocks of its own, and its words ask in each. No pair of words is formed but near ones.
    """
    postings = _postings(words)
    half = ["flipped", "exact", "shared"]
    sizes = postings.groupBy(*half).agg(F.count(F.lit(1)).alias("n_words"))
    hot = checkpointed(sizes.where(F.col("n_words") > block).withColumn("parts", F.ceil(F.col("n_words") / block).cast("int")))
    blocks = max(1, -(-4 * words.count() // block))
    with_parts = postings.join(small_or_not(hot.drop("n_words")), half, "left")
    usual = F.concat_ws(":", F.col("flipped").cast("string"), F.pmod(F.xxhash64("exact", "shared"), F.lit(blocks)).cast("string"))
    part = F.concat_ws(":", F.col("flipped").cast("string"), F.col("exact").cast("string"), F.col("shared"), F.lit("part"))

    def place(number: Column, member: bool, asks: Column) -> Column:
        name = F.concat_ws(":", part, number.cast("string"))
        return F.struct(name.alias("block"), F.lit(member).alias("member"), asks.alias("asks"))

    own = F.pmod(F.xxhash64("word"), F.col("parts").cast("long"))
    split = F.concat(
        F.array(place(own, True, F.lit(False))),
        F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: place(k, False, F.lit(True)))).otherwise(
            F.array().cast("array<struct<block:string,member:boolean,asks:boolean>>")
        ),
    )
    whole = F.array(F.struct(usual.alias("block"), F.lit(True).alias("member"), F.col("asks").alias("asks")))
    placed = with_parts.select(
        "word", "n", "flipped", "exact", F.inline(F.when(F.col("parts").isNull(), whole).otherwise(split))
    )
    found = placed.groupBy("block").applyInArrow(
        near_in_block, "word string, n long, n_near long, best string, best_n long"
    )
    top = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("best"))))
    summed = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), top.alias("top"))
    return summed.select("word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.down")).alias("best_n"))


def spelling_variants(words: DataFrame, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n) rows.

    Two words are near if exactly one inserted, deleted or replaced code point makes the one the other.
    A word's form is its commonest near word (ties: the smallest in code-point order) where that has at least
    ``ratio`` (2 or more) times its occurrences, else null; its root is where following forms ends. Words must be
    distinct and at least two code points long; an empty table gives no rows; other columns are not read.
    Counts at least double from form to form, so roots are found in rounds that double
    the distance looked ahead: a handful for any table.
    """
    kept = checkpointed(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(kept, block)
    is_form = F.col("best_n") >= F.lit(ratio) * F.col("n")
    formed = checkpointed(near.select(
        "word", "n", "n_near",
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ))
    jumps = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = checkpointed(
            jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        jumps = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return formed.join(jumps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
