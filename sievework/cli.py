"""Command line: run, detect, dedup, export, nsfw, seed, cache. A summary in JSON goes to standard output."""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import random
import sys

from sievework import __version__
from sievework.config import POLICIES, Config


# Names of verbs and options are fixed values: they are the interface.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework", description="Curation of image folders on Spark.")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("--scorers", action="append", default=[], help="module that registers model scorers when imported")
    sub = p.add_subparsers(dest="command", required=True)

    def verb(name: str, text: str, inputs=True, unkept=True, cache=True) -> argparse.ArgumentParser:
        v = sub.add_parser(name, help=text)
        if inputs:
            v.add_argument("--input", action="append", nargs="+", required=True, help="input folder(s)")
        if unkept:
            v.add_argument("--unkept", required=True)
            v.add_argument("--copy-instead", action="store_true", help="copy rejected files instead of moving them")
            v.add_argument("--overwrite-unkept", action="store_true")
        if cache:
            v.add_argument("--cache-db", help="folder of the feature table")
            v.add_argument("--cache-anchor", help="folder in which the feature table lies")
            v.add_argument("--no-cache", action="store_true")
            v.add_argument("--device", default="auto", help="accepted; resources are set on the cluster")
        return v

    def near(v: argparse.ArgumentParser) -> None:
        v.add_argument("--similarity", type=float)
        v.add_argument("--phash-hamming", type=int)
        v.add_argument("--clip-batch", "--embed-batch", dest="embed_batch", type=int)
        v.add_argument("--clip-max-size", "--embed-max-size", dest="embed_max_size", type=int)
        v.add_argument("--use-faiss", "--use-vectors", dest="use_vectors", action="store_true", default=None)
        v.add_argument("--faiss-k", "--neighbours", dest="neighbours", type=int)
        v.add_argument("--neighbour-method", choices=["auto", "exact", "lsh"])
        v.add_argument("--rep-policy", choices=POLICIES)

    def seen(v: argparse.ArgumentParser) -> None:
        v.add_argument("--face-backend", choices=["mediapipe", "yunet", "haar", "auto", "off"])
        v.add_argument("--yolo-conf", "--person-conf", dest="person_conf", type=float)
        v.add_argument("--yolo-batch", "--person-batch", dest="person_batch", type=int)

    def shaped(v: argparse.ArgumentParser) -> None:
        v.add_argument("--kept", required=True)
        v.add_argument("--kept-side", type=int)
        v.add_argument("--jpeg-quality", type=int)
        v.add_argument("--no-clean-kept", dest="clean_kept", action="store_false", default=None)

    run = verb("run", "everything: quality, detection, duplicates, export")
    near(run)
    seen(run)
    shaped(run)
    run.add_argument("--skip-detect", action="store_true", default=None)
    run.add_argument("--min-sharpness", type=float)
    run.add_argument("--drop-grayscale", action="store_true", default=None)
    run.add_argument("--drop-bordered", action="store_true", default=None)
    seen(verb("detect", "people and faces only"))
    near(verb("dedup", "duplicates only"))
    export = verb("export", "numbered square crops only", unkept=False, cache=False)
    export.add_argument("--unkept", required=True)
    shaped(export)
    screen = verb("nsfw", "only safe images go to dst", inputs=False, unkept=False)
    screen.add_argument("--src", required=True)
    screen.add_argument("--dst", required=True)
    screen.add_argument("--backend", choices=["classifier", "clip", "auto"], default="auto")
    screen.add_argument("--threshold", dest="unsafe_threshold", type=float)
    screen.add_argument("--batch", dest="person_batch", type=int)
    screen.add_argument("--copy", action="store_true")
    screen.add_argument("--scores", help="Parquet table (path, unsafe_score) in place of a scorer")
    seed = verb("seed", "a sample per category of a local table", inputs=False, unkept=False, cache=False)
    seed.add_argument("--detections", required=True, help="Parquet table (path, category)")
    seed.add_argument("--output", required=True)
    seed.add_argument("--num-categories", type=int, default=1000)
    seed.add_argument("--images-per-category", type=int, default=2)
    seed.add_argument("--side", type=int, default=300)
    seed.add_argument("--seed", type=int, help="random if not given")
    cache = verb("cache", "the feature table", inputs=False, unkept=False, cache=False)
    cache.add_argument("--db", required=True)
    cache.add_argument("action", choices=["info", "prune", "clear"])
    return p


def main(argv: list[str] | None = None, spark=None) -> int:  # noqa: ANN001
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, stream=sys.stderr)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sievework.operators.features import FeatureTable
    from sievework.plans import pipeline
    from sievework.sources.sinks import to_json

    for module in a.scorers:
        importlib.import_module(module)
    try:
        config = Config.of(**vars(a))
        inputs = [x for own in getattr(a, "input", []) for x in own]
        place = getattr(a, "cache_anchor", None) or getattr(a, "kept", None) or getattr(a, "unkept", None) or getattr(a, "dst", None)
        cache = None if getattr(a, "no_cache", True) else a.cache_db or os.path.join(place, ".features")
        spark = spark or SparkSession.builder.appName("sievework").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.command == "run":
            out = pipeline.run_full(spark, inputs, a.kept, a.unkept, config, cache)
        elif a.command == "detect":
            out = pipeline.run_detect(spark, inputs, a.unkept, config, cache)
        elif a.command == "dedup":
            out = pipeline.run_dedup(spark, inputs, a.unkept, config, cache)
        elif a.command == "export":
            out = pipeline.run_export(spark, inputs, a.unkept, a.kept, config)
        elif a.command == "nsfw":
            out = pipeline.run_screen(spark, a.src, a.dst, config, a.backend, not a.copy, spark.read.parquet(a.scores) if a.scores else None, cache)
        elif a.command == "seed":
            out = pipeline.run_seed(spark, spark.read.parquet(a.detections), a.output, a.num_categories, a.images_per_category, a.side, random.randrange(1 << 31) if a.seed is None else a.seed)
        else:
            table = FeatureTable(spark, a.db)
            if a.action == "prune":
                from sievework.sources.files import scan_images

                folders = table.read().select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).where("folder <> ''").distinct()
                roots = sorted(r.folder for r in folders.collect())  # a row for each folder
                out = {"pruned": table.prune(scan_images(spark, roots, content=False).select(F.col("path").alias("key")))}
            elif a.action == "clear":
                table.clear()
                out = {"cleared": True}
            else:
                out = table.info()
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(to_json(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
