"""What the text operators share: column picking, shared scratch tables, word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.plans.scratch import discard, written  # noqa: F401


#: A word is a run of bytes other than these; bytes.split() has the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator needs, so that others, whatever their names, can't clash."""
    return docs.select(*[docs[c] for c in columns])


def crc_of_id(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with about `limit` bytes of text each (one row at least), so that a worker's arrays stay small."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = pc.cumulative_sum(pc.cast(sizes, pa.int64())).to_numpy(zero_copy_only=False)
        start = 0
        while start < n:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def written_in_batches(df: DataFrame, name: str, rows: int = 1000) -> DataFrame:
    """written() of a plan with Python code that takes wide rows: fewer of them are in an Arrow batch, on either side."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Returns freed memory to the system; Python workers live on after a task, and a driver may be small."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def views(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    """The arrays that a column of binaries holds, without a copy."""
    out = []
    for chunk in column.chunks:
        if not len(chunk):
            continue
        chunk = chunk.cast(pa.large_binary())
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        flat = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        out += [flat[a:b].view(kind) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most `most` of them.

    The threshold comes from a histogram of logarithmic levels (a thousand rows at most), so no task has to hold
    or sort that many rows; rows of the level that would exceed the bound stay out."""
    level = F.floor(F.log2(F.col(count)) * 16)
    least, total = None, 0
    for row in sorted(df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += row.n
        if total > most:
            break
        least = row.level
    return df.where(level >= least) if least is not None else df.where(F.lit(False))


def common_words(df: DataFrame, word: str, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, for a broadcast of bounded size: at most `most` words of 64 characters or
    less, and (so that a hot line without a space is no join key) at most a thousand longer ones, each of 65,536
    characters at most and a thousandth of all words."""
    short = most_frequent(df.where(F.length(word) <= 64), count, most)
    total = df.agg(F.sum(count)).first()[0] or 0
    return short.union(df.where((F.length(word) > 64) & (F.length(word) <= 65_536) & (F.col(count) * 1000 >= total) & (F.col(count) > 1)))


def low_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.lower() and bytes.split() touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Remembered(dict):
    """A dict that computes what it lacks; trim() between batches keeps it bounded."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each place in a shingle, made from a counter.
PLACES = mixed(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, given the words' hashes; fewer words make one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += words[k : k + n] * PLACES[k]
    return mixed(total)
