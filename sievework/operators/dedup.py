"""Exact and near duplicates, and the choice of a representative.

Groups are never collected: a group is its key, its representative the minimum of a sort key under that group,
which Spark aggregates before the shuffle. A hot group so costs one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.config import POLICIES
from sievework.functions.expressions import _c, dot
from sievework.operators.graph import connected_components
from sievework.plans.scratch import written


def policy_order(policy: str, size="size", mtime="mtime", sharpness="sharpness") -> list[Column]:
    """Sort keys whose minimum is the representative, before the final tie-break by path."""
    if policy not in POLICIES:
        raise ValueError(f"unknown representative policy {policy!r}; one of {', '.join(POLICIES)}")
    up = {"oldest": mtime}
    down = {"sharpest": sharpness, "largest": size, "newest": mtime}
    if policy in down:
        return [_c(down[policy]).isNull(), -_c(down[policy])]
    return [_c(up[policy]).isNull(), _c(up[policy])] if policy in up else []


def exact_groups(df: DataFrame, digest: str, member: str) -> DataFrame:
    """(digest, n, first) of contents that occur more than once."""
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n"), F.min(member).alias("first")).where("n > 1")


def representatives(df: DataFrame, group: str, member: str, policy: str = "sharpest", **columns: str) -> DataFrame:
    """(group, representative, n): one for each group, ties by the member."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(policy_order(policy, **columns))], F.col(member).alias("m"))
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(key)["m"].alias("representative"), F.count("*").alias("n"))


def survivors(df: DataFrame, group: str, member: str, policy: str = "sharpest", **columns: str) -> DataFrame:
    """The whole row of each group's representative, and all rows without a group; one shuffle, no join."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(policy_order(policy, **columns))], F.col(member).alias("m"))
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(row, key).alias("row")).select("row.*")
    return best.unionByName(df.where(F.col(group).isNull()))


def hamming_pairs(df: DataFrame, item: str, words: Column, bucket: Column, most: int) -> DataFrame:
    """(a, b, distance): pairs a < b of one bucket at most `most` bits apart; the bucket is an equi key."""
    hashed = df.select(F.col(item).alias("item"), words.alias("h"), bucket.alias("bucket")).where("item is not null and bucket is not null")
    a, b = hashed.alias("a"), hashed.alias("b")
    distance = F.aggregate(F.zip_with("a.h", "b.h", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.item") < F.col("b.item")) & (distance <= most)
    return a.join(b, near).select(F.col("a.item").alias("a"), F.col("b.item").alias("b"), distance.alias("distance"))


def hamming_links(df: DataFrame, item: str, words: Column, bucket: Column, most: int) -> DataFrame:
    """Edges that connect the same components as hamming_pairs, with no pairs inside a group of equal hashes.

    Blank assets share one hash: they are linked to the lowest of them, and only that one is compared."""
    hashed = df.select(F.col(item).alias("item"), words.alias("h"), bucket.alias("bucket")).where("item is not null and bucket is not null")
    lowest = hashed.groupBy("bucket", "h").agg(F.min("item").alias("item"))
    equal = hashed.join(lowest.withColumnRenamed("item", "low"), ["bucket", "h"]).where("item <> low").select(F.col("low").alias("a"), F.col("item").alias("b"))
    return hamming_pairs(lowest, "item", F.col("h"), F.col("bucket"), most).select("a", "b").union(equal)


def cosine_pairs(vectors: DataFrame, item: str, vector: str, least: float, within: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of a < b with similarity >= least.

    within(node, component) restricts the comparison to pairs of one component. Either way a task compares two blocks
    of bounded size (see blocked_neighbours), so that a large component is no single task's work. Vectors are of unit
    length; null vectors match nothing."""
    rows = vectors.select(F.col(item).alias("item"), F.col(vector).alias("v")).where("item is not null and v is not null")
    if within is not None:
        rows = rows.join(within.select(F.col("node").alias("item"), F.col("component").alias("g")), "item")
    return _products(rows, None, least, BLOCK_ROWS, once=True).select(F.col("i").alias("a"), F.col("j").alias("b"), "similarity")


BLOCK_ROWS = 4096
#: Up to so many vectors all pairs of blocks are compared by default; beyond, candidates come from hash tables.
EXACT_ROWS = 200_000


def _products(rows: DataFrame, k: int | None, least: float | None, block_rows: int, once: bool = False) -> DataFrame:
    """(i, j, similarity) of rows(item, v[, g]), inside a group g if there is one; `once`: only i < j."""
    kind = rows.schema["item"].dataType.simpleString()
    if "g" not in rows.columns:
        rows = rows.withColumn("g", F.lit(0))
    sizes = written(rows.groupBy("g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "blocks")
    rows = rows.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    # each unordered pair of blocks is enough where pairs count once
    others = F.sequence(F.col("block") if once else F.lit(0), F.col("blocks") - 1)
    before = F.sequence(F.lit(0), F.col("block") if once else F.col("blocks") - 1)
    left = rows.select("g", F.col("block").alias("x"), F.explode(others).alias("y"), "item", "v")
    right = rows.select(F.col("g").alias("h"), F.explode(before).alias("x"), F.col("block").alias("y"), F.col("item").alias("other"), F.col("v").alias("w"))

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("i", a.schema.field("item").type), ("j", a.schema.field("item").type), ("similarity", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("other")
        ids_a, ids_b = a.column("item").combine_chunks(), b.column("other").combine_chunks()
        s = np.array(a.column("v").to_pylist(), np.float64) @ np.array(b.column("w").to_pylist(), np.float64).T
        same = {x: n for n, x in enumerate(ids_b.to_pylist())}
        inside = a.column("x")[0].as_py() == a.column("y")[0].as_py()
        for n, x in enumerate(ids_a.to_pylist()):
            if x in same:
                s[n, same[x]] = -np.inf
        if k is not None:
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(s)), order.shape[1]), order.ravel()
        else:
            at = np.nonzero(s >= least - 1e-9)
        value = s[at]
        keep = value > -np.inf if least is None else value >= least
        i, j = ids_a.take(pa.array(at[0][keep])), ids_b.take(pa.array(at[1][keep]))
        out = pa.table([i, j, pa.array(value[keep])], schema=schema)
        if not once:
            return out
        if inside:
            return out.filter(pc.less(i, j))
        low = pc.if_else(pc.less(i, j), i, j), pc.if_else(pc.less(i, j), j, i)
        return pa.table([*low, out.column("similarity")], schema=schema)

    return left.groupBy("g", "x", "y").cogroup(right.groupBy("h", "x", "y")).applyInArrow(product, f"i {kind}, j {kind}, similarity double")


def blocked_neighbours(vectors: DataFrame, item: str, vector: str, k: int | None, least: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, similarity): for each i its k most similar j (ties by j), or all j from `least` on; exact.

    Rows are cut into blocks of about block_rows; every ordered pair of blocks is one task's matrix product, so a
    task holds two blocks whatever the input, and only its best k a row leave it. All rows meet: the work grows with
    the square of the rows."""
    rows = vectors.select(F.col(item).alias("item"), F.col(vector).alias("v")).where("item is not null and v is not null")
    pairs = _products(rows, k, least, block_rows)
    if k is None:
        return pairs
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "j"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", "similarity", "rank")


def lsh_pairs(vectors: DataFrame, item: str, vector: str, least: float, tables: int = 16, bits: int = 12, seed: int = 17, most: int = 256) -> DataFrame:
    """(a, b, similarity) of a < b; approximate: candidates share the signs of `bits` random projections in one of
    `tables`, and are checked exactly.

    Near linear in the rows; of pairs with a similarity of 0.9 about 93 in 100 meet, of 0.95 nearly all. A key that more
    than `most` items share is cut by as many further signs. Keys travel without the vectors."""
    rows = vectors.select(F.col(item).alias("item"), F.col(vector).alias("v")).where("item is not null and v is not null")
    first = rows.select(F.size("v").alias("d")).first()
    planes = np.random.default_rng(seed).standard_normal((2 * tables * bits, first.d if first else 1))
    shared = rows.sparkSession.sparkContext.broadcast(planes)  # a fixed number of vectors
    kind = rows.schema["item"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(bits)
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            key = ((v @ shared.value.T > 0).reshape(-1, 2 * tables, bits) * weight).sum(2)
            coarse = key[:, :tables] + np.arange(tables) * (1 << bits)
            fine = coarse << bits | key[:, tables:]
            ends = np.arange(0, coarse.size + 1, tables, dtype=np.int32)
            own = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel().astype(np.int64))) for x in (coarse, fine)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], ["item", "coarse", "fine"])

    keyed = rows.mapInArrow(keys, f"item {kind}, coarse array<bigint>, fine array<bigint>").select("item", F.explode(F.arrays_zip("coarse", "fine")).alias("k")).select("item", "k.coarse", "k.fine")
    keyed = written(keyed, "keys")
    hot = written(keyed.groupBy("coarse").count().where(F.col("count") > most).select("coarse"), "hot-keys")
    met = keyed.join(hot, "coarse", "left_anti").select("item", F.col("coarse").alias("key")).union(keyed.join(hot, "coarse", "left_semi").select("item", -F.col("fine") - 1))
    a, b = met.alias("a"), met.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.item") < F.col("b.item"))).select(F.col("a.item").alias("a"), F.col("b.item").alias("b")).distinct()
    whole = pairs.join(rows.select(F.col("item").alias("a"), F.col("v").alias("v")), "a").join(rows.select(F.col("item").alias("b"), F.col("v").alias("w")), "b")
    return whole.select("a", "b", dot("v", "w").alias("similarity")).where(F.col("similarity") >= least)


def lsh_neighbours(vectors: DataFrame, item: str, vector: str, k: int | None, least: float, **options: int) -> DataFrame:
    """(i, j, similarity[, rank]) from lsh_pairs: approximate."""
    pairs = lsh_pairs(vectors, item, vector, least, **options)
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "similarity").union(pairs.select("b", "a", "similarity"))
    if k is None:
        return both
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "j"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_edges(neighbours: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """(a, b) from a neighbour list: symmetric by default; strict takes an edge from the lower item's own list only."""
    near = neighbours.where(F.col("similarity") >= least)
    if strict:
        return near.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def near_groups_by_hash(hashes: DataFrame, vectors: DataFrame, item: str, words: Column, bucket: Column, vector: str, most: int, least: float) -> DataFrame:
    """(node, component): candidates by hash, their components, all pairs inside a component verified by cosine, components again."""
    candidates = connected_components(hamming_links(hashes, item, words, bucket, most), "a", "b")
    return connected_components(cosine_pairs(vectors, item, vector, least, within=candidates), "a", "b")


def near_groups_by_vector(vectors: DataFrame, item: str, vector: str, k: int | None, least: float, strict: bool = False, method: str = "auto") -> DataFrame:
    """(node, component) over the edges of the k nearest neighbours, or (k None) of all pairs from `least` on.

    method: exact compares all rows, lsh only those that meet in hash tables; auto is exact up to EXACT_ROWS. Without k,
    equal vectors are linked to the lowest of them, which alone is compared."""
    rows = vectors.select(F.col(item).alias("item"), F.col(vector).alias("v")).where("item is not null and v is not null")
    if method == "auto":
        method = "exact" if rows.count() <= EXACT_ROWS else "lsh"
    if k is not None:
        near = blocked_neighbours(rows, "item", "v", k) if method == "exact" else lsh_neighbours(rows, "item", "v", k, least)
        return connected_components(neighbour_edges(near, least, strict), "a", "b")
    lowest = rows.groupBy("v").agg(F.min("item").alias("low"))
    equal = rows.join(lowest, "v").where("item <> low").select(F.col("low").alias("a"), F.col("item").alias("b"))
    lowest = written(lowest, "vectors")
    pairs = cosine_pairs(lowest, "low", "v", least) if method == "exact" else lsh_pairs(lowest, "low", "v", least)
    return connected_components(pairs.select("a", "b").union(equal), "a", "b")
