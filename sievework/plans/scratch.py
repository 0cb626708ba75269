"""Tables that cut a lineage and survive lost executors: Parquet in the folder that all executors share.

A table that is read no more is discarded at once; what a result may still read goes when the driver's process ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode, where no cluster names any."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    name = spark.sparkContext.applicationId
    folder = f"{scratch_root(spark)}/{name}"
    if _folders.get(name) != folder:
        _folders[name] = folder
        atexit.register(_removed, spark, folder)
    return folder


def _removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and a folder left behind is no error
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() gave and that nothing will read again, not even a lazy result."""
    for table in tables:
        if path := getattr(table, "_scratch_path", None):
            _removed(table.sparkSession, path)
