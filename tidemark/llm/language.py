"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import in_batches

UNKNOWN = "und"
# N-grams of 1 to 3 characters are hashed into 2**BUCKET_BITS features.
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
MULTIPLIERS = (2654435761, 2246822519, 3266489917)
# The classifier is fitted on about this many labelled rows of each language.
ROWS_PER_LANGUAGE = 500
MOST_LANGUAGES = 1000
FOLDS, HELD_OUT = 4, 2


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of all hashed n-grams; ASCII signs and digits count as blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = points < 128
    points = np.where(plain & ((points < 97) | (points > 122)), np.uint32(32), points)
    total, mixed = np.zeros(BUCKETS, np.int64), None
    for n, factor in enumerate(MULTIPLIERS):
        if len(points) <= n:
            break
        tail = points[n:] * np.uint32(factor)
        mixed = tail if mixed is None else (mixed[: len(tail)] * np.uint32(31)) ^ tail
        total += np.bincount((mixed * np.uint32(MULTIPLIERS[0])) >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def margins(self, counts: np.ndarray) -> np.ndarray:
        if not self.languages:
            return np.zeros(0)
        (at,) = np.nonzero(counts)
        values = np.log1p(counts[at]) * self.idf[at]
        return (values / max(np.sqrt(values @ values), 1e-12)) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 without letters; ties to the first name."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        odds = _softmax(self.margins(gram_counts(text)) / self.temperature)
        best = int(np.argmax(odds))
        return self.languages[best], float(odds[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int,
    alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 42,
) -> np.ndarray:
    """Weights by follow-the-regularised-leader (proximal) with l1 and l2 penalties."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def solved(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in shuffle.permutation(len(rows)):
            at, values = rows[k]
            weights = solved(z[at], n[at])
            gap = _softmax(values @ weights)
            gap[labels[k]] -= 1.0
            gradient = values[:, None] * gap[None, :]
            squared = gradient**2
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha * weights
            n[at] += squared
    return solved(z, n)


def fit_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the margins that gives unseen rows the smallest log loss (golden section)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        x = margins / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def is_held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit_languages(docs: DataFrame, id_column: str = "doc_id", per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """The model of the labelled rows outside the held-out fold.

    About ``per_language`` rows of each language are drawn by a hash of the id; their n-gram
    counts (not texts) come to the driver, where every fifth row is kept for calibration.
    Without labelled rows the model knows no language and answers ``und`` to every text.
    """
    labelled = docs.select(F.col(id_column).cast("string").alias("id"), F.col("text").alias("text"), F.col("lang").alias("lang"), is_held_out(id_column).alias("out"))
    labelled = labelled.where("NOT out AND lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    totals = labelled.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not totals:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    languages = [t["lang"] for t in totals]
    scale = 1 << 32
    bound = F.element_at(
        F.create_map(*[x for t in totals for x in (F.lit(t["lang"]), F.lit(-(-scale * per_language // t["count"])))]), F.col("lang")
    )
    drawn = labelled.where(F.crc32(F.concat(F.lit("fit-"), F.col("id")).cast("binary")) < bound).select("id", "lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers = [], []
            for text in batch.column("text").to_pylist():
                counts = gram_counts(text)
                (at,) = np.nonzero(counts)
                places.append(at.astype("<i4").tobytes())
                numbers.append(counts[at].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("lang"), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())],
                ["id", "lang", "places", "numbers"],
            )

    fetched = in_batches(drawn).mapInArrow(counted, "id string, lang string, places binary, numbers binary").collect()
    fetched.sort(key=lambda r: (r["id"], bytes(r["places"]), bytes(r["numbers"])))
    grams = [(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["numbers"], "<i4")) for r in fetched]
    labels = np.array([languages.index(r["lang"]) for r in fetched], np.int64)
    seen = np.zeros(BUCKETS)
    for at, _ in grams:
        seen[at] += 1
    idf = np.log((1 + len(grams)) / (1 + seen)) + 1
    rows = []
    for at, numbers in grams:
        values = np.log1p(numbers) * idf[at]
        rows.append((at, values / max(np.sqrt(values @ values), 1e-12)))
    kept = np.arange(len(rows)) % 5 != 4
    weights = fit_ftrl([r for r, k in zip(rows, kept) if k], labels[kept], len(languages))
    unseen = [values @ weights[at] for (at, values), k in zip(rows, kept) if not k]
    margins = np.array(unseen).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, fit_temperature(margins, labels[~kept]))


def predicted(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    A null text or one without letters is ``und`` with score 0. Only the text is an input of
    the prediction. Repeated rows are judged each; a null id counts as not held out; an empty
    table gives no rows; other columns are not read.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), is_held_out(id_column).alias("held_out"), F.col("text").alias("text"))
    return in_batches(rows).mapInArrow(judged, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is told with probability ``least`` or more; all columns stay."""
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))

    return in_batches(docs).mapInArrow(kept, docs.schema)
