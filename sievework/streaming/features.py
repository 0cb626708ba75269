"""Continuous ingestion: new files or events into a keyed table, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.functions.expressions import epoch_seconds, is_image_path, sha256_hex
from sievework.operators.features import FeatureTable

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def image_stream(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints and digests of image files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(root).where(is_image_path("path"))
    path = F.regexp_replace("path", r"^file:/+", "/")
    return files.select(path.alias("key"), path.alias("path"), F.col("length").alias("size"), epoch_seconds("modificationTime").alias("mtime"), sha256_hex("content").alias("sha256"))


def into_feature_table(stream: DataFrame, table: FeatureTable, checkpoint: str) -> StreamingQuery:
    """Each batch is merged by key; a batch that is run again after a failure gives the same table."""
    return stream.writeStream.foreachBatch(lambda rows, _: table.upsert(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Tumbling counts and sums with a watermark; works on streams and on tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
