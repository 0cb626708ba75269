"""Packing by minimum bin slack on the histogram of remaining lengths.

A document of L tokens fills L // capacity whole sequences; its last L % capacity tokens remain. Remaining
lengths are below the capacity, so their histogram is bounded whatever the input. For each window the longest
length left is set, and a bitset subset-sum dynamic programme over the others finds the sum closest to the
capacity; backtracking gives how often each length is used, and the window is repeated while the counts last.
Documents then take their places by rank within their length. Ranks come from bounded ranking units, so a
length that a third of the documents share is no single task's work.

Null text counts as empty: the end token alone. Every row is packed, repeated rows and null ids too; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import bpe as bpes
from sievework.llm.common import give_back, pick, small_batches, written_in_batches

UNIT_ROWS = 1000


def fullest(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The reachable sum closest to capacity from below, and a multiset of lengths that gives it."""
    mask, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & mask
            left, k = left - k, 2 * k
        if reach >> capacity:
            break
    best = total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return best, used


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, list[int]]], int]:
    """Windows as (length, first rank, times used in a window, first sequence, offsets), and the number of sequences.

    A window is repeated until some length can't fill it again, so there are a few windows for each length at
    most, not one for each document."""
    counts = {x: n for x, n in histogram.items() if n}
    taken = dict.fromkeys(counts, 0)
    out, sequence = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        _, used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            out.append((x, taken[x], n, sequence, [offset + x * i for i in range(n)]))
            offset += x * n
            taken[x] += n * times
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        sequence += times
    return out, sequence


def packed(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, full = bpes.shared(vocabulary), 0
        for batch in small_batches(batches, "text"):
            size, crc, before = [], [], []
            for ids in bpe.encode_batch(batch.column(2)):
                ids += tail
                size.append(len(ids) // 4)
                crc.append([zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
                before.append(full)
                full += size[-1] // capacity
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(crc, pa.list_(pa.int64())), pa.array(before, pa.int64())], ["row", "doc_id", "doc_tokens", "crc", "full_before"])
        give_back()

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cuts = written_in_batches(rows.mapInArrow(cut, f"row long, doc_id {kind}, doc_tokens long, crc array<long>, full_before long"), "cuts")
    cuts = cuts.withColumn("rest", F.col("doc_tokens") % capacity).withColumn("part", F.shiftright("row", 33))
    histogram = {r.rest: r["count"] for r in cuts.groupBy("rest").count().collect()}  # `capacity` rows at most
    windows, sequences = plan({x: n for x, n in histogram.items() if x}, capacity)
    at: dict[int, list] = {}
    for length, rank, n, sequence, offsets in windows:
        at.setdefault(length, []).append((rank, n, sequence, offsets))
    shared = spark.sparkContext.broadcast({x: (np.array([w[0] for w in own]), own) for x, own in at.items()})  # a few windows for each length

    units = spark.createDataFrame([(x, -(-n // UNIT_ROWS)) for x, n in histogram.items()], "rest long, units long")
    cuts = cuts.join(F.broadcast(units), "rest").withColumn("unit", F.pmod(F.xxhash64("row"), F.col("units"))).drop("units")
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cuts.groupBy("rest", "unit").count().select("rest", "unit", F.coalesce(F.sum("count").over(upto("rest", "unit")), F.lit(0)).alias("rank_before"))
    # a row for each task of the scan
    parts = cuts.groupBy("part").agg(F.max(F.col("full_before") + F.floor(F.col("doc_tokens") / capacity)).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    rank = F.row_number().over(Window.partitionBy("rest", "unit").orderBy("row")) - 1
    ready = cuts.withColumn("rank", rank).join(ranked, ["rest", "unit"]).join(parts, "part")
    ready = ready.select("doc_id", "doc_tokens", "crc", "rest", (F.col("rank") + F.col("rank_before")).alias("rank"), (F.col("part_before") + F.col("full_before") + sequences).alias("first_full"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, numbers = [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 6)]
            for i, (size, crc, rest, rank, full) in enumerate(zip(*columns, strict=True)):
                for k, c in enumerate(crc):
                    owner.append(i)
                    if k < size // capacity:
                        numbers.append((k * capacity, capacity, c, size, full + k, 0))
                    else:
                        ranks, own = shared.value[rest]
                        first, n, sequence, offsets = own[int(ranks.searchsorted(rank, side="right")) - 1]
                        numbers.append((k * capacity, rest, c, size, sequence + (rank - first) // n, offsets[(rank - first) % n]))
            made = np.array(numbers, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *map(pa.array, made.T.copy())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ready.mapInArrow(put, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
