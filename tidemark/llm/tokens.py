"""Token counts and byte-pair encoding of whole texts; the encoder itself is in ``bpe``."""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bpe import encoder
from tidemark.llm.common import id_and_text, in_batches


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each; a null
    id stays null; an empty table gives no rows; other columns are not read. Whole texts are
    counted, piece by piece, so memory is bounded by one batch of texts. ``PrefixTable``
    answers the same for every prefix of a text.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            numbers = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(numbers, pa.int64()),
                    pa.array([n > limit for n in numbers], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return in_batches(id_and_text(docs, id_column)).mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def _little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens and the exact ids as an array, or the digests of a round trip.

    With ``digests``: ids_sha256 (ids as little-endian unsigned 32-bit numbers) and
    decoded_sha256 (the text decoded from the ids, UTF-8) instead of the ids.

    A null text counts as empty and has no ids. Repeated rows are encoded each; a null id
    stays null; an empty table gives no rows; other columns are not read.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            lengths, hashes, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.ids(text)
                lengths.append(len(ids))
                hashes.append(hashlib.sha256(_little_endian(ids)).hexdigest())
                decoded.append(hashlib.sha256(own.bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            found = [own.ids(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "n_tokens", "ids"],
            )

    rows = in_batches(id_and_text(docs, id_column))
    if digests:
        return rows.mapInArrow(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(listed, "doc_id long, n_tokens long, ids array<int>")
