"""Scans of image folders and the small tables around them."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import codecs
from sievework.functions.expressions import epoch_seconds, is_image_path, relative_path, sha256_hex
from sievework.schema import ASSETS, OUTCOMES, struct

log = logging.getLogger(__name__)


def resolved(path: str) -> str:
    """Absolute, with ~ expanded; addresses with a scheme stay as they are."""
    return path.rstrip("/") if "://" in path or path.startswith("file:/") else os.path.abspath(os.path.expanduser(path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _plain(path):
    return F.regexp_replace(path, r"^file:/+", "/")


def scan_images(spark: SparkSession, roots: Iterable[str], content: bool = True) -> DataFrame:
    """assets(path, root, rel_path, size, mtime[, content]); a missing root is logged and left out.

    Names with a leading dot or underscore and empty files are not listed by Spark's file source. Suffixes are
    compared in lower case, which the source's own name filter would not do. The content column is only read
    where a later step asks for it."""
    parts = []
    for root in map(resolved, roots):
        if not _exists(spark, root):
            log.warning("no such folder: %s", root)
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(is_image_path("path"))
        path = _plain("path")
        columns = [path.alias("path"), F.lit(root).alias("root"), relative_path(path, F.lit(root)).alias("rel_path"), F.col("length").alias("size"), epoch_seconds("modificationTime").alias("mtime")]
        parts.append(files.select(*columns, *(["content"] if content else [])))
    if not parts:
        return spark.createDataFrame([], struct("path string, root string, rel_path string, size bigint, mtime double, content binary") if content else ASSETS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collect_inputs(spark: SparkSession, roots: Iterable[str], content: bool = True) -> DataFrame:
    """scan_images, but a missing root is an error and a file under overlapping roots counts once (under its longest root)."""
    roots = [resolved(r) for r in roots]
    for r in roots:
        if not _exists(spark, r):
            raise ValueError(f"input folder does not exist: {r}")
    distinct = list(dict.fromkeys(roots))
    out = scan_images(spark, distinct, content)
    inner = [r for r in distinct if any(r != o and r.startswith(o + "/") for o in distinct)]
    if inner:  # rows of an outer root that lie in an inner one are the same files
        twice = F.lit(False)
        for r in inner:
            twice = twice | (F.startswith("path", F.lit(r + "/")) & (F.length("root") < len(r)))
        out = out.where(~twice)
    return out


def count_images(spark: SparkSession, root: str) -> int:
    return scan_images(spark, [root], content=False).count()


def with_digest(assets: DataFrame) -> DataFrame:
    return assets.withColumn("sha256", sha256_hex("content"))


#: As many paths are given to the image source by name at most; beyond that it reads the roots.
NAMED = 10_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def wild_free(path: str):
    """A path in which no character is a wildcard."""
    return F.regexp_replace(path, r"([*?\[\]{}\\])", r"\\$1")


def _image_source(spark: SparkSession, assets: DataFrame) -> DataFrame | None:
    """(path, height, width, nChannels, data) by the JVM's readers: of these files alone if they are few, else of their roots."""
    from pyspark.errors import AnalysisException

    named = assets.select(wild_free("path").alias("path")).limit(NAMED + 1).collect()
    if not named:
        return None
    read = spark.read.format("image").option("recursiveFileLookup", "true")
    roots = [r.root for r in assets.select("root").distinct().collect()] if "root" in assets.columns else []
    try:
        found = read.load([r.path for r in named] if len(named) <= NAMED or not roots else roots)
    except AnalysisException:  # one of them has gone since the scan
        if not roots:
            raise
        found = read.load(roots)
    found = found.select("image.*").where("height > 0")
    return found.select(_plain(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))).alias("path"), "height", "width", "nChannels", "data")


def pixels(spark: SparkSession, assets: DataFrame, upright: bool = True) -> DataFrame:
    """(path, image): decoded RGB with its size, upright by EXIF unless told not to; null where no decoder reads the file.

    assets(path, content[, root]). PNG is decoded from the bytes at hand; other formats go through the JVM's readers in
    the image source, which opens only the files that are asked for."""
    other = F.coalesce(F.substring("content", 1, len(SIGNATURE)) != F.lit(SIGNATURE), F.lit(True))
    jvm = _image_source(spark, assets.where(other))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_packed(codecs.from_png(x) if x else None) for x in batch.column(1).to_pylist()]
            turn = [codecs.orientation(x or b"") if upright else 1 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(turn, pa.int32())], ["path", "image", "turn"])

    first = assets.select("path", "content").mapInArrow(decode, "path string, image binary, turn int")
    if jvm is None:
        return first.select("path", "image")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, turn, h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                if own is None and data is not None and h * w <= codecs.PIXELS:
                    image = np.frombuffer(data, np.uint8).reshape(h, w, c)
                    own = _packed(np.repeat(image, 3, 2) if c == 1 else image[..., 2::-1], turn)
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "image"])

    return first.join(jvm, "path", "left").select("path", "image", "turn", "height", "width", "nChannels", "data").mapInArrow(convert, "path string, image binary")


def _packed(image: np.ndarray | None, turn: int = 1) -> bytes | None:
    """Height and width as two 32-bit numbers, then the pixels."""
    if image is None:
        return None
    from sievework.functions.kernels import turned

    image = np.ascontiguousarray(turned(image, turn))
    return np.array(image.shape[:2], "<u4").tobytes() + image.tobytes()


def unpacked(data: bytes | None) -> np.ndarray | None:
    if data is None:
        return None
    h, w = np.frombuffer(data[:8], "<u4")
    return np.frombuffer(data, np.uint8, offset=8).reshape(int(h), int(w), 3)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The log with `line`, which rises along a file."""
    return spark.read.schema(OUTCOMES).option("header", True).option("escape", '"').csv(path).withColumn("line", F.monotonically_increasing_id())


def read_classes(spark: SparkSession, path: str, column: str = "DisplayName") -> DataFrame:
    return spark.read.option("header", True).csv(path).select(column)


def read_detections(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A local table (path, category) in place of a downloaded detection set."""
    return spark.read.format(format).load(path).select("path", "category")
