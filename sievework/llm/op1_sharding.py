"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group and stay together, unless a group is so large that no shard could take it
beside others; such a group is split by a hash of its rows. Small groups are gathered into a fixed number of
hash cells, large ones stand alone, so the packing itself sees a bounded number of items at any input size.
Items are placed in falling size, each into the shard where the dot product of its vector with the shard's
residual capacity is highest. Slots are numbered without a global sort: offsets of bounded ranking units plus
the row number within a unit.

Only digests of texts move between tasks. Null text: no bytes and no tokens, checksum 0, a group of its own.
Repeated rows and null ids are rows like others. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import WORD, pick, written

CELLS_PER_SHARD = 1024
#: A group is large from this share of a shard, and is split from that share.
LARGE, SPLIT = 1 / 256, 1 / 2
UNIT_ROWS = 100_000


#: Of bytes, tokens and rows in the dot product; bytes are the law that must come out near equal.
WEIGHTS = (4, 1, 1)


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; vectors are shares of the whole in each dimension."""
    residual = np.full((shards, vectors.shape[1]), 1 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -vectors[:, 0], -vectors.max(1))):
        v = vectors[i]
        fits = (residual >= v - 1e-12).all(1)
        score = (residual * WEIGHTS) @ v
        out[i] = at = np.argmax(np.where(fits, score, -np.inf)) if fits.any() else np.argmax(score)
        residual[at] -= v
    return out


def sharded(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tokens, shard, slot): slots count from 0 in each shard."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    narrow = written(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64("text", F.col("text").isNull()).alias("key"),
        ),
        "sizes",
    )
    same = ["key", "text_crc32", "size"]
    total = narrow.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    whole = [max(1, total.size or 0), max(1, total.tokens or 0), max(1, total.rows)]
    share = lambda size, tokens, n: F.greatest(size / F.lit(whole[0]), tokens / F.lit(whole[1]), n / F.lit(whole[2]))
    groups = narrow.groupBy(same).agg(F.count("*").alias("n"), F.sum("tokens").alias("all_tokens"))
    groups = groups.withColumn("share", share(F.col("n") * F.col("size"), F.col("all_tokens"), F.col("n"))).where(F.col("share") >= LARGE / shards)
    # shares of one dimension sum to 1, so at most 3 * shards / LARGE groups are large
    large = groups.orderBy(F.desc("share"), *same).limit(3 * round(shards / LARGE)).collect()
    first, start = [], shards * CELLS_PER_SHARD
    for g in large:
        parts = min(g.n, max(1, round(g.share * shards / SPLIT * 8))) if g.share > SPLIT / shards else 1
        first.append((g.key, g.text_crc32, g.size, start, parts))
        start += parts
    named = spark.createDataFrame(first, "key long, text_crc32 long, size long, start long, parts long")
    cell = F.when(F.col("start").isNull(), F.pmod(F.xxhash64("key", "size"), F.lit(shards * CELLS_PER_SHARD))).otherwise(F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts")))
    dealt = narrow.join(F.broadcast(named), same, "left").withColumn("cell", cell).drop("start", "parts")
    items = dealt.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).toPandas().sort_values("cell")
    shard = place(items[["size", "tokens", "rows"]].to_numpy(float) / whole, shards)
    plan = [(int(c), int(s), -(-int(n) // UNIT_ROWS)) for c, s, n in zip(items["cell"], shard, items["rows"], strict=True)]
    placed = dealt.join(F.broadcast(spark.createDataFrame(plan, "cell long, shard int, units long")), "cell")
    placed = placed.withColumn("unit", F.pmod(F.xxhash64("row", F.lit(1)), F.col("units")))
    units = placed.groupBy("shard", "cell", "unit").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("cell", "unit").rowsBetween(Window.unboundedPreceding, -1))
    units = units.select("shard", "cell", "unit", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "cell", "unit").orderBy("row")) - 1
    numbered = placed.withColumn("number", number).join(units, ["shard", "cell", "unit"])
    return numbered.select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("before") + F.col("number")).alias("slot"))
