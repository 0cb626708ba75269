"""BPE encoding and decoding of documents by batched numpy merge rounds (see bpe.py).

A scan without a shuffle. Null text counts as empty: no ids, and the empty string decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm import bpe as bpes
from sievework.llm.common import pick, small_batches


def encoded(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpes.shared(vocabulary)
        for batch in small_batches(batches, "text", 1 << 20):
            ids = bpe.encode_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), hashed where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpes.shared(vocabulary)
        for batch in small_batches(batches, "text"):
            ids = bpe.encode_batch(batch.column(1))
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
