"""Sinks: plans are tables, applied by idempotent file operations on the executors."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import codecs, kernels
from sievework.operators.export import collision_free, manifest, mirror_plan, numbered
from sievework.plans.scratch import written
from sievework.sources.files import NAMED, unpacked, wild_free


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _put(src: str, dst: str, move: bool, sha256: str | None, overwrite: bool = False) -> str:
    """Copies through a temporary name; a repeated task finds its own result and stops. Sources go last.

    A file that came to the destination since the plan was made stays, and so does the source."""
    if not os.path.exists(src):
        return "done" if sha256 and os.path.exists(dst) and _digest(dst) == sha256 else "missing"
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    same = os.path.exists(dst) and _digest(dst) == (sha256 or _digest(src))
    if not same and os.path.exists(dst) and not overwrite:
        return "taken"
    if not same:
        temporary = f"{dst}.{os.getpid()}.tmp"
        try:
            shutil.copy2(src, temporary)
            os.replace(temporary, dst)
        finally:
            if os.path.exists(temporary):
                os.unlink(temporary)
    if move:
        os.unlink(src)
    return "done"


def apply_plan(plan: DataFrame, move: bool = False) -> DataFrame:
    """plan(src, final, action, sha256) carried out; (src, final, done). The folder must be mounted on all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for src, final, action, sha in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    if action == "skip":
                        if move and os.path.exists(src) and os.path.exists(final) and _digest(final) == (sha or _digest(src)):
                            os.unlink(src)
                        done.append(True)
                    else:
                        done.append(_put(src, final, move, sha, action == "overwrite") == "done")
                except OSError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.bool_())], ["src", "final", "done"])

    return written(plan.select("src", "final", "action", "sha256").mapInArrow(run, "src string, final string, done boolean"), "applied")


def existing_files(spark, folder: str, wanted: DataFrame) -> DataFrame:  # noqa: ANN001
    """(dst, sha256) of all files below a folder; only files whose name is wanted(dst) are read, others have no digest."""
    none = spark.createDataFrame([], "dst string, sha256 string")
    if not os.path.isdir(folder):
        return none
    load = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    name = F.regexp_replace("path", r"^file:/+", "/").alias("dst")
    names = written(load(folder).select(name), "names")
    met = names.join(wanted.select("dst").distinct(), "dst", "left_semi")
    few = [r.dst for r in met.select(wild_free("dst").alias("dst")).limit(NAMED + 1).collect()]
    if not few:
        return names.select("dst", F.lit(None).cast("string").alias("sha256"))
    read = load(few if len(few) <= NAMED else folder).select(name, F.sha2("content", 256).alias("sha256"))
    return names.join(read.join(met, "dst", "left_semi"), "dst", "left")


def mirror(rejected: DataFrame, unkept: str, move: bool = False, overwrite: bool = False) -> DataFrame:
    """rejected(path, rel_path, sha256) below `unkept` with the tree kept; (src, final, done).

    Equal bytes at the destination are left alone; other files there are overwritten or a free name is taken. Of several
    files that would overwrite the same one the last does, the others get free names."""
    spark, unkept = rejected.sparkSession, unkept.rstrip("/")
    wanted = rejected.select(F.col("path").alias("src"), F.concat(F.lit(unkept + "/"), "rel_path").alias("dst"), "sha256")
    existing = written(existing_files(spark, unkept, wanted), "existing")
    plan = mirror_plan(wanted, existing, overwrite)
    last = plan.where("action = 'overwrite'").groupBy("dst").agg(F.max("src").alias("last"))
    plan = plan.join(last, "dst", "left").withColumn("action", F.when((F.col("action") == "overwrite") & (F.col("src") != F.col("last")), "rename").otherwise(F.col("action"))).drop("last")
    plan = written(plan, "plan")
    keep = plan.where(F.col("action").isin("skip", "overwrite")).withColumn("final", F.col("dst"))
    fresh = collision_free(plan.where(~F.col("action").isin("skip", "overwrite")), "dst", "src", existing)
    return apply_plan(keep.unionByName(fresh.select(*keep.columns)), move)


def move_safe(safe: DataFrame, target: str, move: bool = True) -> DataFrame:
    """safe(path, sha256) into one flat folder under free names."""
    spark, target = safe.sparkSession, target.rstrip("/")
    plan = safe.select(F.col("path").alias("src"), F.concat(F.lit(target + "/"), F.substring_index("path", "/", -1)).alias("dst"), "sha256").withColumn("action", F.lit("copy"))
    existing = written(existing_files(spark, target, plan.where(F.lit(False))), "existing")
    return apply_plan(collision_free(plan, "dst", "src", existing), move)


def clear_folder(folder: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg")) -> int:
    """Removes the files directly in the folder that have one of these suffixes."""
    gone = 0
    for entry in os.scandir(folder) if os.path.isdir(folder) else ():
        if entry.is_file() and os.path.splitext(entry.name)[1].lower() in suffixes:
            os.unlink(entry.path)
            gone += 1
    return gone


def export_numbered(images: DataFrame, kept: str, side: int = 300, quality: int = 92, clean: bool = True, order=("path",)) -> DataFrame:
    """images(path, image) as kept/1.jpg, 2.jpg, ... by path; the manifest of what was written.

    Numbers are given first, so unreadable images leave gaps."""
    kept = kept.rstrip("/")
    os.makedirs(kept, exist_ok=True)
    if clean:
        clear_folder(kept)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for index, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                image = unpacked(data)
                if image is None or not image.size:
                    done.append(False)
                    continue
                final = f"{kept}/{index}.jpg"
                temporary = f"{final}.{os.getpid()}.tmp"
                try:
                    with open(temporary, "wb") as f:
                        f.write(codecs.jpeg(kernels.crop_square(image, side), quality))
                    os.replace(temporary, final)
                    done.append(True)
                except OSError:
                    if os.path.exists(temporary):
                        os.unlink(temporary)
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.bool_())], ["index", "path", "done"])

    rows = numbered(images.select("path", "image"), *order).select("index", "path", "image")
    done = written(rows.mapInArrow(write, "index bigint, path string, done boolean"), "exported")
    return manifest(done.where("done"))


def write_csv(rows: DataFrame, path: str, *order: str) -> str:
    """One file with a header, in order; written under a temporary name first. For logs and manifests."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.tmp"
    with open(temporary, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        out.writerows(rows.orderBy(*order).toLocalIterator())
    os.replace(temporary, path)
    return path


def to_json(summary: dict) -> str:
    return json.dumps(summary, indent=2, default=str)
