"""SimHash fingerprints, the likeness of neighbours, and all pairs within a Hamming radius.

Terms are runs of three lower-cased words (all words of a shorter text as one), weighted by frequency.
Each term's 128 hash bits vote with its weight; the sign of the sums is the fingerprint.

near_fingerprints() finds every pair within a radius r by permuted block tables: the bits fall into r + 2
blocks, of which two must be equal in any such pair, so a table for each choice of two blocks, led by those
blocks, has all pairs as equal keys. Equal fingerprints are collapsed first. A key that more than MOST fingerprints
share is cut again: the other bits fall into r + 1 pieces, of which one must be equal. near_counts() turns the pairs
into the number of other documents within the radius; copies count by the size of their group, never as pairs.

with_edits() compares each document with an edited form whose last quarter is replaced by the beginning of the
next document. Rows are range-partitioned by id (ties by a hash of the text), so the next document is the next
row of the stream; only the two edge rows of each partition travel again.

Null text counts as empty (fingerprint of no votes: all zero bits); null ids come first; repeated rows follow
each other; a table of one row has itself as next; an empty table gives an empty result. Long texts are read in batches
of their own. Null fingerprints are near nothing.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import Remembered, low_words, mixed, pick, shingle_hashes, small_batches, written

BITS, SHINGLE = 128, 3
RADIUS, MOST = 3, 64


class SimHash:
    def __init__(self):
        self.words = Remembered(xxhash.xxh3_64_intdigest)

    def of(self, text: str | None) -> bytes:
        words = low_words(text)
        if not words:
            return bytes(BITS // 8)
        self.words.trim()
        hashed = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        terms, n = np.unique(shingle_hashes(hashed, SHINGLE), return_counts=True)
        weight = n.astype(np.float32)
        both = np.stack([terms, mixed(terms ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
        votes = np.zeros(BITS, np.float64)
        for i in range(0, len(terms), 4096):
            bits = np.unpackbits(both[i : i + 4096].view(np.uint8), axis=1)
            votes += weight[i : i + 4096] @ bits.astype(np.float32)
        return np.packbits(2 * votes > weight.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) with the fingerprint in hexadecimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = SimHash()
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash.of(x).hex() for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_edits(docs: DataFrame, radius: int | None = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near).

    n_near: how many other documents have a fingerprint within the radius; without a radius it is left out."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in result.split(", ")]
    made = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(simhash: SimHash, own: str, mark: bytes, after: str, after_mark: bytes) -> tuple:
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        other = mark if edited == own else simhash.of(edited)
        return len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark.hex(), other.hex(), likeness(mark, other), likeness(mark, after_mark)

    def table(ids: list, rows: list[tuple], like: pa.Field) -> list[pa.Array]:
        columns = zip(*rows, strict=True) if rows else [[]] * len(made)
        return [pa.array(ids, like.type), *(pa.array(list(c), t) for c, t in zip(columns, made, strict=True))]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows (edge null) and the first and last row of the partition, with their texts."""
        simhash, last, part = SimHash(), None, TaskContext.get().partitionId()
        like = None

        def out(ids: list, rows: list[tuple], edge: int | None = None, own: str | None = None, tie: int = 0) -> pa.RecordBatch:
            n = len(ids)
            more = [pa.array([edge] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array([own] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*table(ids, rows, like), *more], [*names, "edge", "tie", "own"])

        empty = (None,) * len(made)
        for batch in small_batches(batches, "text"):
            like = batch.schema.field(0)
            ids, done = [], []
            for key, own, tie in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                mark = simhash.of(own)
                if last is None:
                    yield out([key], [empty], 2 * part, own, tie)
                else:
                    ids.append(last[0])
                    done.append(compare(simhash, last[1], last[2], own, mark))
                last = key, own, mark, tie
            yield out(ids, done)
        if last is not None:
            yield out([last[0]], [empty], 2 * part + 1, last[1], last[3])

    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    passed = written(ordered.mapInArrow(stream, f"{result}, edge long, tie long, own string"), "edited")
    edges = passed.where("edge is not null").select("doc_id", "edge", "tie", "own")
    # two narrow rows for each partition: a first row, then the last row of the same partition, and so on
    order = Window.orderBy(F.col("doc_id").asc_nulls_first(), "tie", F.col("edge") % 2, "edge")
    chain = edges.select("edge", F.lead("edge").over(order).alias("after"), F.first("edge").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    chain = chain.where("edge % 2 = 1").select("edge", F.coalesce("after", "first").alias("after"))
    ends = edges.join(chain, "edge").select("doc_id", "own", "after")
    nexts = edges.select(F.col("edge").alias("after"), F.col("own").alias("next"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = SimHash()
        for batch in batches:
            done = [compare(simhash, a, simhash.of(a), b, simhash.of(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(table(batch.column(0).to_pylist(), done, batch.schema.field(0)), names)

    late = ends.join(nexts, "after").select("doc_id", "own", "next").mapInArrow(finish, result)
    out = passed.where("edge is null").select(*names).unionByName(late)
    if radius is None:
        return out
    # the edge rows' own fingerprints come with the late ones
    marks = out.select("fingerprint")
    near = written(near_counts(marks, radius), "near-counts")
    return out.join(near, "fingerprint", "left").select(*names, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _bits(hi: Column, lo: Column, start: int, stop: int) -> Column:
    """Bits start to stop (from the highest) of the 128 in two longs, at most 64, as one long."""
    take = lambda x, a, b: F.shiftrightunsigned(F.shiftleft(x, a), 64 - (b - a)) if b > a else F.lit(0).cast("long")
    if stop <= 64:
        return take(hi, start, stop)
    if start >= 64:
        return take(lo, start - 64, stop - 64)
    return F.shiftleft(take(hi, start, 64), stop - 64).bitwiseOR(take(lo, 0, stop - 64))


def _pieces(lead: tuple[int, ...], ends: list[int], n: int) -> list[list[tuple[int, int]]]:
    """The bits outside the lead blocks as n pieces, each a list of ranges."""
    rest = [b for i in range(len(ends) - 1) if i not in lead for b in range(ends[i], ends[i + 1])]
    out = []
    for k in range(n):
        own = rest[round(k * len(rest) / n) : round((k + 1) * len(rest) / n)]
        starts = [i for i, b in enumerate(own) if not i or b != own[i - 1] + 1] + [len(own)]
        out.append([(own[i], own[j - 1] + 1) for i, j in itertools.pairwise(starts)])
    return out


def near_fingerprints(marks: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b, distance): all pairs a < b of different fingerprints at most `radius` bits apart.

    marks has a column fingerprint (hexadecimal); who holds a fingerprint is a join with marks."""
    half = lambda at: F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long")
    distinct = marks.select("fingerprint").where("fingerprint is not null").distinct().select(half(1).alias("hi"), half(17).alias("lo"))
    blocks = max(3, radius + 2)
    ends = [round(i * BITS / blocks) for i in range(blocks + 1)]
    hashed = lambda *ranges: F.xxhash64(*[_bits(F.col("hi"), F.col("lo"), i, j) for r in ranges for i, j in ([r] if r[1] - r[0] <= 64 else [(r[0], r[0] + 64), (r[0] + 64, r[1])])])
    lead = list(itertools.combinations(range(blocks), blocks - radius if blocks > radius else 1))
    keys = F.array(*[F.xxhash64(F.lit(k), hashed(*[(ends[i], ends[i + 1]) for i in own])) for k, own in enumerate(lead)])
    tables = written(distinct.select("hi", "lo", F.posexplode(keys).alias("table", "key")), "block-tables")
    hot = written(tables.groupBy("table", "key").count().where(F.col("count") > most).select("table", "key"), "hot-blocks")
    pieces = [F.array(*[hashed(*p) for p in _pieces(own, ends, radius + 1)]) for own in lead]
    of_table = pieces[-1]
    for k in range(len(lead) - 1):
        of_table = F.when(F.col("table") == k, pieces[k]).otherwise(of_table)
    cut = tables.join(hot, ["table", "key"], "left_semi").select("hi", "lo", "table", "key", F.posexplode(of_table).alias("piece", "bits"))
    cut = cut.select("hi", "lo", F.xxhash64("table", "key", "piece", "bits").alias("key"))
    met = tables.join(hot, ["table", "key"], "left_anti").select("hi", "lo", "key").union(cut)
    a, b = met.alias("a"), met.alias("b")
    distance = F.bit_count(F.col("a.hi").bitwiseXOR(F.col("b.hi"))) + F.bit_count(F.col("a.lo").bitwiseXOR(F.col("b.lo")))
    name = lambda x: F.lower(F.concat(F.lpad(F.hex(f"{x}.hi"), 16, "0"), F.lpad(F.hex(f"{x}.lo"), 16, "0")))
    same = (F.col("a.key") == F.col("b.key")) & (F.struct("a.hi", "a.lo") < F.struct("b.hi", "b.lo")) & (distance <= radius)
    pairs = a.join(b, same).select(name("a").alias("x"), name("b").alias("y"), distance.alias("distance")).distinct()
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def near_counts(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near): how many other rows of marks have a fingerprint within the radius; only where there are any."""
    held = written(marks.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n")), "fingerprints")
    pairs = near_fingerprints(held, radius)
    around = pairs.select(F.col("a").alias("fingerprint"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    others = around.join(held.select(F.col("fingerprint").alias("other"), F.col("n").alias("n_other")), "other").groupBy("fingerprint").agg(F.sum("n_other").alias("n_others"))
    counted = held.join(others, "fingerprint", "left").select("fingerprint", (F.col("n") - 1 + F.coalesce("n_others", F.lit(0))).alias("n_near"))
    return counted.where("n_near > 0")
