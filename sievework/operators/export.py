"""Numbering, masks, collision names and mirror plans: side effects as tables first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.plans.scratch import written


def numbered(df: DataFrame, *order: str | Column, index: str = "index") -> DataFrame:
    """df with a number from 1 in a global order, without sorting everything in one task.

    Rows are range-partitioned and sorted; a number is its partition's offset plus the place inside it. Rows
    equal in all sort keys are numbered in any order."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return ranged.withColumn("__part", part).join(offsets, "__part").withColumn(index, (F.col("__before") + place + 1).cast("bigint")).drop("__part", "__before", "__at")


def manifest(exported: DataFrame, index: str = "index", path: str = "path") -> DataFrame:
    """Rows that could be written; numbers were given before, so unreadable rows leave gaps."""
    return exported.select(F.col(index).alias("index"), F.concat(F.col(index).cast("string"), F.lit(".jpg")).alias("filename"), F.col(path).alias("original_path"))


def masked(inputs: DataFrame, unkept: DataFrame, by_root: bool = False) -> DataFrame:
    """Inputs whose relative path isn't in the mask; of all roots alike, unless by_root."""
    keys = ["root", "rel_path"] if by_root else ["rel_path"]
    return inputs.join(unkept.select(*keys).distinct(), keys, "left_anti")


def _place_in(index: DataFrame, group: str) -> DataFrame:
    """numbered rows with their place from 1 within a group that the order begins with; a hot group is no window."""
    first = index.groupBy(group).agg(F.min("__index").alias("__first"))
    return index.join(first, group).withColumn("__place", F.col("__index") - F.col("__first") + 1).drop("__first", "__index")


def collision_free(planned: DataFrame, dst: str, order: str | list[str], existing: DataFrame | None = None) -> DataFrame:
    """planned with `final`: the first to claim a free name has it, the others get `stem (n).ext` with the first free n.

    existing(dst) holds names already taken; a name that some row of the plan asks for is nobody else's either, so all
    final names differ. Only a name with a plain number from 1 counts as a numbered one."""
    order = [order] if isinstance(order, str) else order
    columns = planned.columns
    claims = _place_in(numbered(planned, dst, *order, index="__index"), dst)
    there = (existing if existing is not None else planned.where(F.lit(False))).select(dst).distinct()
    claims = claims.join(there.withColumn("__there", F.lit(True)), dst, "left")
    claims = written(claims.withColumn("__k", F.col("__place") - F.when(F.col("__there"), 0).otherwise(1)).drop("__place", "__there"), "claims")
    number = F.regexp_extract(dst, r" \(([1-9]\d{0,8})\)(\.[^./]*)?$", 1).try_cast("bigint")
    taken = there.union(planned.select(dst)).distinct().select(F.regexp_replace(dst, r" \([1-9]\d{0,8}\)(?=(\.[^./]*)?$)", "").alias(dst), number.alias("n")).where("n is not null")
    # below a taken number lie n - place free ones: in the order of free numbers the k-th claim stands at its own number
    below = F.col("n") - F.row_number().over(Window.partitionBy(dst).orderBy("n"))
    marks = taken.join(claims.where("__k > 0").select(dst).distinct(), dst, "left_semi").select(dst, below.alias("__at"), F.lit(0).alias("__late"), F.lit(None).cast("bigint").alias("__k"))
    wanting = claims.where("__k > 0").select(dst, (F.col("__k") - 1).alias("__at"), F.lit(1).alias("__late"), "__k")
    free = _place_in(numbered(marks.unionByName(wanting), dst, "__at", "__late", index="__index"), dst).where("__late = 1")
    named = claims.join(free.select(dst, "__k", "__place"), [dst, "__k"], "left")
    name, ext = F.regexp_replace(dst, r"(?<=[^/])\.[^./]*$", ""), F.regexp_extract(dst, r"[^/](\.[^./]*)$", 1)
    final = F.when(F.col("__k") == 0, F.col(dst)).otherwise(F.concat(name, F.lit(" ("), F.col("__place").cast("string"), F.lit(")"), ext))
    return named.select(*columns, final.alias("final"))


def mirror_plan(rejected: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """rejected(src, dst, sha256) with existing(dst, sha256): what to do with each.

    skip where the destination holds the same bytes, overwrite or rename where it holds others, else copy."""
    e = existing.select(F.col("dst"), F.col("sha256").alias("have"))
    joined = rejected.join(e, "dst", "left")
    action = F.when(F.col("have").isNull(), "copy").when(F.col("have") == F.col("sha256"), "skip").otherwise("overwrite" if overwrite else "rename")
    return joined.withColumn("action", action).drop("have")


def review(rejected: DataFrame, outcomes: DataFrame, limit: int = 400) -> DataFrame:
    """The first rejected files by path with their caption: the reason, or the path where none is recorded.

    Of several reasons the last line of the log counts, or without line numbers the highest."""
    reason = F.max_by("reason", "line") if "line" in outcomes.columns else F.max("reason")
    last = outcomes.groupBy("rel_path").agg(reason.alias("reason"))
    return rejected.orderBy("rel_path").limit(limit).join(last, "rel_path", "left").withColumn("caption", F.coalesce("reason", "rel_path")).orderBy("rel_path")
