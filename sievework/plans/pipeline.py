"""Whole runs: curation, detection, duplicates, screening, export. Intermediate tables are written to the shared folder as a
run goes on; other files are touched at the end."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.config import Config
from sievework.functions import kernels, scorers
from sievework.functions.expressions import bucket32, normalised
from sievework.operators import dedup, features, filters, summaries
from sievework.operators.export import masked
from sievework.operators.sampling import sample_seed
from sievework.plans.scratch import written
from sievework.sources import files, sinks


@dataclass
class CurationResult:
    """outcomes(path, rel_path, root, reason): a row for each input, reason null for survivors."""

    outcomes: DataFrame
    kept: DataFrame
    summary: DataFrame


def curate(assets: DataFrame, config: Config = Config(), key: str = "path") -> CurationResult:
    """The decisions of a run on a table of features; beyond tables in the shared folder, nothing is touched.

    assets needs `key`, and the columns of the stages that are on: sharpness, saturation, border_frac; has_person,
    has_face; sha256; phash or embedding; size, mtime, sharpness_full for the representative. Each stage sees
    only what no earlier stage rejected, so every asset has one reason at most."""
    reason = F.lit(None).cast("string")
    if config.quality_on:
        reason = F.coalesce(reason, filters.quality_reason(config))
    if not config.skip_detect:
        reason = F.coalesce(reason, filters.detection_reason())
    judged = written(assets.withColumn("reason", reason), "judged")
    rows = judged.where("reason is null")
    sharp = "sharpness_full" if "sharpness_full" in assets.columns else "sharpness"
    by = {"sharpness": sharp}

    best = dedup.representatives(rows, "sha256", key, config.rep_policy, **by).where("n > 1").select("sha256", "representative")
    exact = written(rows.join(best, "sha256", "left").select(key, (F.col("representative").isNotNull() & (F.col(key) != F.col("representative"))).alias("gone")).where("gone").select(key), "exact")
    rows = rows.join(exact, key, "left_anti")

    vectors = rows.select(key, normalised("embedding").alias("v"))
    if config.use_vectors:
        groups = dedup.near_groups_by_vector(vectors, key, "v", config.neighbours, config.similarity, config.strict_edges, config.neighbour_method)
    else:
        hashed = rows.where(F.col("phash").isNotNull())
        groups = dedup.near_groups_by_hash(hashed, vectors, key, F.col("phash"), bucket32("phash"), "v", config.phash_hamming, config.similarity)
    grouped = written(rows.join(groups.withColumnRenamed("node", key), key), "near-groups")
    best = dedup.representatives(grouped, "component", key, config.rep_policy, **by)
    near = written(grouped.join(best, "component").where(F.col(key) != F.col("representative")).select(key), "near")

    late = exact.select(key, F.lit("duplicate_exact").alias("late")).union(near.select(key, F.lit("duplicate_near")))
    outcomes = written(judged.join(late, key, "left").withColumn("reason", F.coalesce("reason", "late")).drop("late"), "outcomes")
    return CurationResult(outcomes, outcomes.where("reason is null"), summaries.run_summary(outcomes))


MEASURES = "path string, sharpness double, saturation double, border_frac double, sharpness_full double, phash array<bigint>, readable boolean"


def measure(images: DataFrame) -> DataFrame:
    """(path, quality metrics, hash) of images(path, image), from one decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                image = files.unpacked(data)
                out.append((None,) * 5 + (False,) if image is None or not image.size else (*kernels.quality(image), kernels.sharpness_full(image), kernels.perceptual_hash(image), True))
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = [pa.float64()] * 4 + [pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [x.split()[0] for x in MEASURES.split(", ")])

    return images.select("path", "image").mapInArrow(run, MEASURES)


#: A run commits its features in slices of about so many assets; what a broken run has committed isn't computed again.
SLICE_ROWS, MOST_SLICES = 200_000, 64


def _computed(spark: SparkSession, todo: DataFrame, config: Config, detect: bool) -> DataFrame:
    """todo(path, root, content, ...) with all features."""
    new = todo.join(measure(files.pixels(spark, todo)), "path", "left").withColumn("sha256", F.sha2("content", 256))
    if detect:
        person, face = scorers.resolve("person"), scorers.resolve("face", config.face_backend)
        new = scorers.apply_scorer(new, person, "has_person", "boolean", config.person_batch, config.fail_open)
        if face is None:
            new = new.withColumn("has_face", F.lit(False))
        else:  # the dearer scorer sees only what the first one left
            new = written(new, "persons")
            seen = scorers.apply_scorer(new.where(~F.coalesce("has_person", F.lit(False))), face, "has_face", "boolean", config.person_batch, config.fail_open)
            new = seen.unionByName(new.where("has_person").withColumn("has_face", F.lit(False)), allowMissingColumns=True)
    if "embedding" in scorers_available():
        new = scorers.apply_scorer(new, scorers.resolve("embedding"), "embedding", "array<float>", config.embed_batch)
    return new.withColumn("params", F.lit(config.fingerprint())).withColumn("updated_at", F.current_timestamp())


def _featured(spark: SparkSession, assets: DataFrame, config: Config, table: features.FeatureTable | None, detect: bool) -> DataFrame:
    """assets with all features: those in the table, and the rest computed and put there slice by slice."""
    keyed = assets.withColumn("key", F.col("path"))
    if table is None:
        out = written(_computed(spark, keyed, config, detect), "features").drop("key", "content", "params", "updated_at")
    else:
        known = features.lookup(keyed, table.read(), config.fingerprint())
        wanted = [*(["has_person", "has_face"] if detect else []), *(["embedding"] if "embedding" in scorers_available() else [])]
        open_ = functools.reduce(lambda x, y: x | y, [F.col(c).isNull() for c in wanted], F.lit(False))
        # an unreadable file has no scores, now or later
        todo = written(known.where(F.col("sha256").isNull() | (open_ & F.coalesce("readable", F.lit(True)))).select(*keyed.columns), "todo")
        slices = min(MOST_SLICES, -(-todo.count() // SLICE_ROWS))
        for k in range(slices):
            table.upsert(_computed(spark, todo.where(F.pmod(F.xxhash64("path"), F.lit(slices)) == k), config, detect))
        out = features.lookup(keyed.drop("content"), table.read(), config.fingerprint()).drop("key", "cached")
    for c, kind in (("embedding", "array<float>"), ("has_person", "boolean"), ("has_face", "boolean")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out


def scorers_available() -> set[str]:
    return {k for k in ("person", "face", "embedding", "unsafe") if scorers.names(k)}


def run_full(spark: SparkSession, inputs: list[str], kept: str, unkept: str, config: Config = Config(), cache: str | None = None) -> dict:
    """Scan, decide, mirror the rejected, export the survivors; the summary of the run.

    Detection needs registered scorers (or skip_detect); near duplicates need embeddings to be verified."""
    detect = not config.skip_detect
    if detect:  # before any long work
        scorers.resolve("person")
        scorers.resolve("face", config.face_backend)
    assets = written(files.collect_inputs(spark, inputs), "assets")
    if assets.isEmpty():
        return {"total_input": 0, "exported": 0}
    table = None if config.no_cache else features.FeatureTable(spark, cache or os.path.join(kept, ".features"))
    result = curate(_featured(spark, assets, config, table, detect), config)
    rejected = result.outcomes.where("reason is not null").select("path", "rel_path", "sha256", "reason")
    survivors = assets.join(result.kept.select("path"), "path", "left_semi")
    pictures = files.pixels(spark, survivors)
    listed = written(sinks.export_numbered(pictures, kept, config.kept_side, config.jpeg_quality, config.clean_kept), "manifest")
    sinks.write_csv(listed, os.path.join(kept, "manifest.csv"), "index")
    done = sinks.mirror(rejected, unkept, not config.copy_instead, config.overwrite_unkept)
    # the name that a rejected file really has, so that a renamed one still finds its reason
    final = done.select(F.col("src").alias("path"), F.substring("final", len(unkept.rstrip("/")) + 2, 1 << 20).alias("final_rel"), "done")
    log = rejected.join(final, "path", "left").select(F.coalesce("final_rel", "rel_path").alias("rel_path"), "reason", F.col("path").alias("original_path"))
    sinks.write_csv(log, os.path.join(unkept, "outcomes.csv"), "original_path")
    summary = result.summary.first().asDict()
    summary.pop("survivors")
    extra = {"exported": listed.count(), "kept_dir": kept, "unkept_dir": unkept, "manifest_csv": os.path.join(kept, "manifest.csv"), "outcomes_csv": os.path.join(unkept, "outcomes.csv"), "mirrored": done.where("done").count()}
    return summary | extra | {"cache_info": table.info() if table else None}


def run_detect(spark: SparkSession, inputs: list[str], unkept: str, config: Config = Config(), cache: str | None = None) -> dict:
    scorers.resolve("person")
    assets = written(files.collect_inputs(spark, inputs), "assets")
    if assets.isEmpty():
        return {"total": 0, "moved_to_unkept": 0}
    table = features.FeatureTable(spark, cache) if cache else None
    found = _featured(spark, assets, config, table, True).withColumn("reason", filters.detection_reason())
    done = sinks.mirror(found.where("reason is not null"), unkept, not config.copy_instead, config.overwrite_unkept)
    return {"total": assets.count(), "moved_to_unkept": done.where("done").count()}


def run_dedup(spark: SparkSession, inputs: list[str], unkept: str, config: Config = Config(), cache: str | None = None) -> dict:
    config = Config(**{**config.__dict__, "skip_detect": True, "min_sharpness": 0.0, "drop_grayscale": False, "drop_bordered": False})
    assets = written(files.collect_inputs(spark, inputs), "assets")
    if assets.isEmpty():
        return {"total": 0, "rejected_exact": 0, "rejected_near": 0, "survivors": 0}
    table = features.FeatureTable(spark, cache) if cache else None
    result = curate(_featured(spark, assets, config, table, False), config)
    sinks.mirror(result.outcomes.where("reason is not null"), unkept, not config.copy_instead, config.overwrite_unkept)
    return summaries.dedup_summary(result.outcomes).first().asDict()


def run_export(spark: SparkSession, inputs: list[str], unkept: str, kept: str, config: Config = Config(), by_root: bool = False) -> dict:
    assets = files.collect_inputs(spark, inputs)
    mask = files.scan_images(spark, [unkept], content=False)
    rows = written(masked(assets, mask, by_root), "unmasked")
    pictures = files.pixels(spark, rows)
    listed = written(sinks.export_numbered(pictures, kept, config.kept_side, config.jpeg_quality, config.clean_kept), "manifest")
    path = sinks.write_csv(listed, os.path.join(kept, "manifest.csv"), "index")
    return {"total_input": assets.count(), "unkept_mirrored": mask.select("rel_path").distinct().count(), "exported": listed.count(), "manifest": path}


def run_screen(spark: SparkSession, src: str, dst: str, config: Config = Config(), backend: str = "auto", move: bool = True, scores: DataFrame | None = None, cache: str | None = None) -> dict:
    """Only what scores below the threshold goes to dst. scores(path, unsafe_score) may come from anywhere; else a registered scorer gives them."""
    assets = written(files.collect_inputs(spark, [src]), "assets")
    if assets.isEmpty():
        return {"total": 0, "moved": 0, "blocked": 0, "skipped": 0}
    table = features.FeatureTable(spark, cache) if cache else None
    known = assets.withColumn("key", F.col("path"))
    if scores is not None:
        scored = assets.join(scores, "path", "left")
    else:
        params = f"backend={backend}"
        old = features.lookup(known, table.read(), unsafe_params=params).select("path", "unsafe_score") if table else known.select("path", F.lit(None).cast("double").alias("unsafe_score"))
        todo = known.join(old.where("unsafe_score is null").select("path"), "path", "left_semi")
        new = written(scorers.apply_scorer(todo, scorers.resolve("unsafe", backend), "unsafe_score", "double", config.person_batch), "scores")
        if table:
            table.upsert(new.where("unsafe_score is not null").withColumn("unsafe_params", F.lit(params)).withColumn("updated_at", F.current_timestamp()))
        scored = assets.join(old.where("unsafe_score is not null").union(new.select("path", "unsafe_score")), "path", "left")
    routed = written(scored.withColumn("route", filters.screen_route("unsafe_score", config.unsafe_threshold)).withColumn("sha256", F.sha2("content", 256)).drop("content"), "routes")
    out = filters.screen_summary(routed, config.unsafe_threshold, backend).first().asDict()
    done = sinks.move_safe(routed.where("route = 'moved'"), dst, move)
    failed = done.where("not done").count()
    return out | {"moved": out["moved"] - failed, "skipped": out["skipped"] + failed}


def run_seed(spark: SparkSession, detections: DataFrame, output: str, categories: int = 1000, per_category: int = 2, side: int = 300, seed: int = 0) -> dict:
    """A sample of a local detection table (path, category), cropped and numbered."""
    chosen = written(sample_seed(detections, "category", "path", categories, per_category, seed).select("path").distinct(), "sample")
    paths = [r.path for r in chosen.orderBy("path").limit(categories * per_category).collect()]  # bounded by the two limits
    if not paths:
        return {"downloaded": 0, "processed": 0, "failed": 0, "output_dir": output}
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "content")
    listed = sinks.export_numbered(files.pixels(spark, raw, upright=False), output, side, 92, clean=False)  # seeds are cropped as stored
    n = listed.count()
    return {"downloaded": len(paths), "processed": n, "failed": len(paths) - n, "output_dir": output}
