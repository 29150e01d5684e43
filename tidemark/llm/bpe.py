"""Byte-pair encoding by dynamic programming over prefixes.

The encoding of a prefix is that of a shorter prefix plus one last token, and that token
is unique. It is found among the vocabulary entries that end the prefix (a suffix
automaton of the vocabulary lists them, longest first) as the one whose pair with the
shorter prefix's last token byte-pair merging would leave apart.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

# White space as the Unicode property has it, spelled out because libraries differ on \s.
SPACE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The piece patterns of the two public vocabulary files.
BYTE_PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"
# Symbol of a byte that ends a word, in vocabularies with word ends.
LAST = 256
NEVER = 1 << 60
# Entries that a table of known pieces or pairs holds before it is emptied.
MOST_KNOWN = 250_000
# Longer pieces are encoded anew each time, so that the tables stay small.
LONGEST_KNOWN = 64


class SuffixAutomaton:
    """All substrings of the given strings; strings are sequences of numbers."""

    def __init__(self, strings: list[tuple[int, ...]]):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends = []
        for string in strings:
            state = 0
            for symbol in string:
                state = self._extended(state, symbol)
            self.ends.append(state)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state of exactly ``state``'s strings plus ``symbol``."""
        target = self.step[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        short = self._state(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = short
        while state >= 0 and self.step[state].get(symbol) == target:
            self.step[state][symbol] = short
            state = self.link[state]
        return short

    def _extended(self, last: int, symbol: int) -> int:
        if symbol in self.step[last]:
            return self._split(last, symbol)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and symbol not in self.step[state]:
            self.step[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol)
        return new


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixBpe:
    """A byte-level vocabulary with ranked merges, as stored in a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.word_ends = model["end_of_word_suffix"] == WORD_END
        self.lowers = stored["normalizer"] is not None
        self.pieces = regex.compile(WORD_PIECES if self.word_ends else BYTE_PIECES)
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.shown = {number: token for token, number in model["vocab"].items()} | {n: t for t, n in self.special.items()}
        self._cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        bytes_of = byte_symbols()

        def symbols(token: str) -> tuple[int, ...]:
            marked = self.word_ends and token.endswith(WORD_END) and len(token) > len(WORD_END)
            plain = [bytes_of[c] for c in (token[: -len(WORD_END)] if marked else token)]
            return (*plain[:-1], plain[-1] + LAST) if marked else tuple(plain)

        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merge: dict[int, int] = {}
        self._above: dict[int, list[tuple[int, int]]] = {}
        self._below: dict[int, list[tuple[int, int]]] = {}
        self._apart: dict[int, bool] = {}
        for rank, (left, right) in enumerate(pairs):
            whole, a, b = vocab[left + right], vocab[left], vocab[right]
            self.merge.setdefault(a << 32 | b, rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), rank
        spelled = {n: symbols(t) for t, n in vocab.items() if t not in self.special}
        kept = [n for n, s in spelled.items() if len(s) == 1 or (n in self.parts and self._stays(n))]
        self.size = {n: len(spelled[n]) for n in kept}
        automaton = SuffixAutomaton([spelled[n] for n in kept])
        self._step, self._link, self._length = automaton.step, automaton.link, automaton.length
        own = dict(zip(automaton.ends, kept))
        # For each state, all tokens that end its strings, longest first, as linked pairs.
        order = sorted(range(len(self._step)), key=self._length.__getitem__)
        self._tokens: list[tuple | None] = [None] * len(order)
        for state in order:
            rest = self._tokens[self._link[state]] if state else None
            self._tokens[state] = (own[state], self.size[own[state]], rest) if state in own else rest

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of ``token`` while it is built, each with the rank that ends it."""
        known = self._above if side else self._below
        if token not in known:
            spine, ends = [], NEVER
            at: int | None = token
            while at is not None:
                spine.append((at, ends))
                ends, at = self.rank.get(at, NEVER), self.parts[at][side] if at in self.parts else None
            known[token] = spine[::-1]
        return known[token]

    def _meets(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether a merge of rank below ``before`` crosses the border of two tokens."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.merge.get(x << 32 | y, NEVER)
            # Equal merges go from left to right: the border's comes after x's, before y's.
            if rank < before and rank < x_ends and rank <= y_ends:
                return True
            if x_ends == NEVER and y_ends == NEVER:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _stays(self, token: int) -> bool:
        """Whether the token's own spelling is encoded as that one token."""
        return not self._meets(*self.parts[token], before=self.rank[token])

    def apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) >= 2 * MOST_KNOWN:
                self._apart.clear()
            found = self._apart[key] = not self._meets(left, right)
        return found

    def symbols(self, piece: str) -> list[int]:
        symbols = list(piece.encode("utf-8", "replace"))
        if self.word_ends:
            symbols[-1] += LAST
        return symbols

    def last_tokens(self, symbols: list[int]) -> list[int]:
        """The last token of every prefix's encoding; entry 0 belongs to the empty prefix."""
        step, link, length, tokens, apart, known = self._step, self._link, self._length, self._tokens, self._apart, self.apart
        last, state, matched = [-1], 0, 0
        for end, symbol in enumerate(symbols, 1):
            while state and symbol not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(symbol, 0)
            matched = matched + 1 if state else 0
            # The automaton's state may hold longer strings than the one matched.
            while state and matched <= length[link[state]]:
                state = link[state]
            node, found = tokens[state], -1
            while node is not None:
                token, size, node = node
                if size > matched:
                    continue
                if size == end:
                    found = token
                    break
                before = last[end - size]
                if before >= 0 and (apart.get(before << 32 | token) or known(before, token)):
                    found = token
                    break
            last.append(found)
        return last

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, by following the last tokens back from its end."""
        last = self.last_tokens(self.symbols(piece))
        at, ids = len(last) - 1, []
        while at > 0:
            ids.append(last[at])
            at -= self.size[last[at]]
        return ids[::-1]

    def prefix_counts(self, piece: str) -> list[int]:
        """Number of tokens of every byte prefix of one piece."""
        last, counts = self.last_tokens(self.symbols(piece)), [0]
        for end in range(1, len(last)):
            counts.append(counts[end - self.size[last[end]]] + 1)
        return counts

    def normal(self, text: str) -> str:
        if not self.lowers:
            return text
        text = regex.sub(f"[{SPACE}]+", " ", unicodedata.normalize("NFC", text))
        # Letters are lowered one by one, so a sigma that ends a word is like any other.
        return text.replace("Σ", "σ").lower()

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Special tokens (id, no pieces) and the pieces of the text between them."""
        start = 0
        for match in self._cut.finditer(text):
            if match.start() > start:
                yield None, self.pieces.findall(self.normal(text[start : match.start()]))
            yield self.special[match.group()], []
            start = match.end()
        if start < len(text):
            yield None, self.pieces.findall(self.normal(text[start:] if start else text))

    def decode(self, ids: list[int]) -> str:
        """Texts of a vocabulary without a decoder: the stored tokens with blanks between."""
        return " ".join(map(self.shown.__getitem__, ids))


class Known(dict):
    """Remembers ``make(piece)`` for short pieces; emptied when full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= LONGEST_KNOWN:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[piece] = value
        return value


class Encoder:
    def __init__(self, bpe: PrefixBpe):
        self.bpe = bpe
        self.packed = Known(lambda piece: array("I", bpe.encode_piece(piece)).tobytes())
        self.counted = Known(lambda piece: bpe.prefix_counts(piece)[-1])

    def ids(self, text: str) -> array:
        parts = []
        for special, pieces in self.bpe.segments(text):
            parts.append(array("I", [special]).tobytes() if special is not None else b"".join(map(self.packed.__getitem__, pieces)))
        out = array("I")
        out.frombytes(b"".join(parts))
        return out

    def count(self, text: str) -> int:
        return sum(1 if special is not None else sum(map(self.counted.__getitem__, pieces)) for special, pieces in self.bpe.segments(text))


class PrefixTable:
    """Token counts of all prefixes of one text, for budgets and truncation without encoding again.

    Pieces are those of the whole text; offsets are bytes of the normalised text's pieces.
    """

    def __init__(self, bpe: PrefixBpe, text: str):
        self.counts = array("q", [0])
        for special, pieces in bpe.segments(text):
            if special is not None:
                size = len(bpe.shown[special].encode())
                self.counts.extend([self.counts[-1] + 1] * size)
            for piece in pieces:
                base = self.counts[-1]
                self.counts.extend(base + n for n in bpe.prefix_counts(piece)[1:])

    def count(self, n_bytes: int | None = None) -> int:
        return self.counts[-1 if n_bytes is None else n_bytes]

    def longest_within(self, budget: int) -> int:
        """Bytes of the longest prefix that takes at most ``budget`` tokens."""
        return max(k for k, n in enumerate(self.counts) if n <= budget)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    return Encoder(PrefixBpe(path))
