"""Packing, periodic runs and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, periodic, spelling
from tidemark.llm.queries import QUERIES, with_planted_runs

DATA = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, start long, length string, word string, n string, h int, runs string, _position long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "w", 2, "v", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    words = ["alpha", "alphas", "alpha", "Alpha", "été", "日本", "x1", "don't", "12", "##", "überall", "uberall"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 80))) for _ in range(40)]
    texts += [None, "", "  \n", "word " * 6000, "a" * 3000, "tick tock " * 40, texts[0], "<|endoftext|> x <|endoftext|>", "x \x85 \xa0 ² é y"]
    return [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, "alpha beta"), (None, None)]


def real(name):
    import duckdb

    return duckdb.connect().execute(f"SELECT * FROM '{DATA}/{name}.parquet'").fetchall()


# ---- packing ----------------------------------------------------------------------------------


def check_sequences(found, capacity):
    """Every sequence is gapless from offset 0 and within the capacity; number of sequences."""
    by_sequence = defaultdict(list)
    for row in found:
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def fewest(lengths, capacity):
    """Sequences that any packing needs at least, also where long documents leave room that nothing fills."""
    lengths, least = np.array(lengths), 0
    for short in range(capacity // 2 + 1):
        alone = (lengths > capacity - short).sum()
        half = lengths[(lengths <= capacity - short) & (lengths > capacity / 2)]
        rest = lengths[(lengths <= capacity / 2) & (lengths >= short)].sum()
        least = max(least, alone + len(half) + max(0, -(-int(rest - len(half) * capacity + half.sum()) // capacity)))
    return int(least)


@pytest.mark.parametrize("capacity", [1024, 50])
def test_packing_holds_every_token_once(spark, rows, capacity):
    library = Tokenizer.from_file(BYTES)
    found = packing.packed(table(spark, rows), BYTES, capacity).collect()
    expected = Counter()
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        ends = [0, *range(first, len(ids) + 1, capacity)]
        expected.update((key, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in found) == expected
    assert all(r["length"] == len(r["ids"]) for r in found)
    least = fewest([r["length"] for r in found], capacity)
    assert least <= check_sequences(found, capacity) <= least * 1.02 + 1


def test_packing_query_on_real_documents(spark):
    library = Tokenizer.from_file(BYTES)
    found = QUERIES["op11_best_fit_packing"](spark, DATA).collect()
    checksums = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found}
    assert len(checksums) == len(found)
    pieces = 0
    for key, text, *_ in real("documents"):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            assert checksums[key, k] == (start, length, zlib.crc32(ids[start : start + length].tobytes()))
            pieces += 1
    assert pieces == len(found)
    least = fewest([r["length"] for r in found], 1024)
    assert least <= check_sequences(found, 1024) <= least * 1.01 + 2


def test_least_squares_use_up_a_histogram_made_of_patterns():
    draw = np.random.default_rng(2)
    lengths = np.arange(1, 64)
    patterns = packing.patterns_of(lengths, 64)
    filled = np.append(lengths, 0)[patterns].sum(1)
    assert (filled == 64).all() and len(np.unique(patterns, axis=0)) == len(patterns)
    wanted = sum(1 for a in range(1, 64) for b in range(a, 64) if a + b == 64)
    wanted += sum(1 for a in range(1, 64) for b in range(a, 64) if 64 - a - b >= b)
    assert len(patterns) == wanted
    counts = np.zeros(64)
    for k in draw.choice(len(patterns), 40, replace=False):
        for p in patterns[k]:
            counts[p] += 1000
    x = packing.fitted_repeats(patterns, counts[:63])
    used = sum(np.bincount(patterns[:, s], x, 64) for s in range(3))[:63]
    assert (x >= 0).all() and np.abs(used - counts[:63]).max() < 1 and (x > 0).sum() <= 63
    plan = packing.packing_plan(np.concatenate([[0], counts[:63], [5]]).astype(int), 64)
    total = int((counts[:63] * lengths).sum()) // 64 + 5
    assert total <= plan.total <= total * 1.005


def test_packing_of_hot_lengths_and_of_nothing(spark):
    counts = np.zeros(1025, int)
    counts[700], counts[1024] = 10**9, 10**6
    assert packing.packing_plan(counts).total == 10**9 + 10**6
    counts[700], counts[3] = 0, 10**9
    assert packing.packing_plan(counts).total == 10**6 + -(-(10**9) // 341)
    same = table(spark, [(k, "one and the same text of a few words") for k in range(3000)])
    found = packing.packed(same, BYTES).collect()
    each = 1024 // found[0]["length"]
    assert check_sequences(found, 1024) == -(-3000 // each)
    assert packing.packed(table(spark, []), BYTES).collect() == []


# ---- periodic runs ----------------------------------------------------------------------------


def brute_runs(words, least=24):
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, 3 * p):
                if not any(all(words[t] == words[t + q] for t in range(i, i + length - q)) for q in range(1, p)):
                    out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(key, words):
    runs = brute_runs(words)
    dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_equal_brute_force_on_random_texts():
    draw = random.Random(3)
    texts = []
    for _ in range(250):
        few, text = draw.choice([1, 2, 3, 10, 50]), []
        while len(text) < draw.randrange(1, 250):
            kind = draw.random()
            if kind < 0.4 or not text:
                text += [f"w{draw.randrange(few)}" for _ in range(draw.randrange(1, 30))]
            elif kind < 0.8:
                unit = [draw.choice("abc") for _ in range(draw.randrange(1, 20))]
                text += unit * draw.randrange(1, 8) + unit[: draw.randrange(len(unit))]
            else:
                start = draw.randrange(len(text))
                text += text[start : start + draw.randrange(1, 40)]
        texts.append(text)
    texts += [[], ["a"], ["a"] * 24, ["a"] * 23]
    for least in (24, 6):
        for k in range(0, len(texts), 40):
            assert periodic.runs_of(texts[k : k + 40], least) == [brute_runs(t, least) for t in texts[k : k + 40]]


def test_runs_of_long_texts_take_little_time():
    assert periodic.runs_of([["a"] * 200_000]) == [[(0, 200_000, 1)]]
    assert periodic.runs_of([[w for k in range(8000) for w in (f"u{k}", *["x"] * 17)]]) == [[]]


def test_runs_on_odd_rows(spark, rows):
    found = periodic.periodic_runs(table(spark, rows)).collect()
    expected = Counter()
    for key, text in rows:
        words = WORDS.findall(text or "")
        runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
        expected[key, len(words), tuple(runs), " ".join(w for k, w in enumerate(words) if k not in dropped)] += 1
    got = Counter((r["doc_id"], r["n_words"], tuple((x.start, x.length, x.period) for x in r["runs"]), r["collapsed"]) for r in found)
    assert got == expected
    assert periodic.periodic_runs(table(spark, [])).collect() == []


def test_runs_query_on_real_documents(spark):
    found = QUERIES["op12_periodic_runs"](spark, DATA)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {key for key, text, *_ in real("documents") if len(text or "") < 6000}
    expected = sorted(brute_row(key, planted(key, WORDS.findall(text or ""))) for key, text, *_ in real("documents") if key in short)
    assert sorted(tuple(r) for r in found.collect() if r["doc_id"] in short) == expected
    assert sum(r[1] > 0 for r in expected) > 5


def test_planting_leaves_null_and_empty_texts(spark):
    docs = table(spark, [(k, t) for k in range(60) for t in (None, "", " \t")])
    assert {r["text"] for r in with_planted_runs(docs).collect()} == {None, "", " \t"}


# ---- spelling variants ------------------------------------------------------------------------


def brute_variants(counts, ratio=2):
    """Near words share the word itself or a word with one letter less; each pair is then compared."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    shorter = defaultdict(set)
    for w in counts:
        shorter[w].add(w)
        for k in range(len(w)):
            shorter[w[:k] + w[k + 1 :]].add(w)
    partners = defaultdict(set)
    for group in shorter.values():
        for a in group:
            partners[a].update(b for b in group if b not in partners[a] and a != b and near(a, b))
    form = {}
    for w, n in counts.items():
        best = min(partners[w], key=lambda c: (-counts[c], c), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(partners[w]), counts[form[w]] if form[w] else None))
    return out


def brute_vocabulary(rows, spoilt=None):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if spoilt and h % spoilt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("block", [40_000, 7])
def test_variants_equal_brute_force_also_where_halves_are_hot(spark, block):
    draw = random.Random(5)
    counts = {}
    while len(counts) < 260:
        letters = draw.choice(["ab", "abé", "abc日"])
        counts["".join(draw.choice(letters) for _ in range(draw.randrange(2, 9)))] = draw.choice([3, 4, 6, 8, 50, 99])
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit(1)).withColumn("block", F.lit("b"))
    found = spelling.spelling_variants(words, block=block).collect()
    assert len(found) == len(counts)
    assert {tuple(r) for r in found} == brute_variants(counts)


def test_vocabulary_of_odd_rows(spark, rows):
    for spoilt in (None, 3):
        found = {r["word"]: r["n"] for r in spelling.vocabulary(table(spark, rows), spoilt=spoilt).collect()}
        assert found == brute_vocabulary(rows, spoilt)
    none = spelling.vocabulary(table(spark, []))
    assert none.collect() == [] and spelling.spelling_variants(none).collect() == []


def test_variants_query_on_real_documents(spark):
    found = QUERIES["op13_spelling_variants"](spark, DATA)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute_variants(brute_vocabulary([r[:2] for r in real("documents")], 97))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert sum(r[1] is not None for r in rows) > 20
