"""The incremental feature table: validity by fingerprint, merge, prune and counts.

A row is valid for an asset of the same key when sizes are equal, times differ by `tolerance` seconds at most and
the options that shaped the features are the same. A stale row's features never survive a merge. Features come in
families (schema.FAMILIES), each with its own options, so that computing one family leaves the others as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.plans.scratch import written
from sievework.schema import FAMILIES, FEATURES, conform

TOLERANCE = 1.0
STAMP = ("key", "path", "size", "mtime", *FAMILIES, "updated_at")
FAMILY = {c: params for params, columns in FAMILIES.items() for c in columns}


def valid(a_size: Column, a_mtime: Column, b_size: Column, b_mtime: Column, tolerance: float = TOLERANCE) -> Column:
    return (a_size == b_size) & (F.abs(a_mtime - b_mtime) <= tolerance)


def lookup(assets: DataFrame, features: DataFrame, params: str | None = None, tolerance: float = TOLERANCE, **options: str) -> DataFrame:
    """assets(key, size, mtime, ...) with every feature column, null where no valid row exists; one join for all features.

    params, and options for other families, name the options that a family's values must have been made with."""
    wanted = options | ({"params": params} if params is not None else {})
    values = [c for c in features.columns if c not in STAMP and c not in assets.columns]
    f = features.alias("f")
    ok = (F.col("a.key") == F.col("f.key")) & valid(F.col("a.size"), F.col("a.mtime"), F.col("f.size"), F.col("f.mtime"), tolerance)
    joined = assets.alias("a").join(f, ok, "left")

    def value(c: str) -> Column:
        own = FAMILY.get(c)
        return F.when(F.col(f"f.{own}").eqNullSafe(F.lit(wanted[own])), F.col(f"f.{c}")) if own in wanted and own in features.columns else F.col(f"f.{c}")

    cached = F.col("f.key").isNotNull()
    if params is not None and "params" in features.columns:
        cached = cached & F.col("f.params").eqNullSafe(F.lit(params))
    return joined.select("a.*", cached.alias("cached"), *[value(c).alias(c) for c in values])


def missing(assets: DataFrame, features: DataFrame, *columns: str, params: str | None = None, **options: str) -> DataFrame:
    """The assets for which one of these columns has to be computed."""
    looked = lookup(assets, features, params, **options)
    need = functools.reduce(lambda x, y: x | y, [F.col(c).isNull() for c in columns], F.lit(False))
    if not options:
        need = need | ~F.col("cached")
    return looked.where(need).select(*assets.columns)


def merge(old: DataFrame, new: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """old updated by new: column by column while the fingerprint is the same, whole rows when it changed.

    While it is the same within the tolerance, the old size and time stay. A family that new brings with other
    options replaces the old one as a whole; one that new doesn't bring (its options are null) stays."""
    names = [c for c in old.columns if c != "key"]
    o, n = old.alias("o"), new.alias("n")
    same = F.coalesce(valid(F.col("o.size"), F.col("o.mtime"), F.col("n.size"), F.col("n.mtime"), tolerance), F.lit(False))
    gone = F.col("n.key").isNull()

    def pick(c: str) -> Column:
        fresh, was = (F.col(f"n.{c}") if c in new.columns else F.lit(None)), F.col(f"o.{c}")
        if c in ("size", "mtime"):
            return F.when(gone | same, was).otherwise(fresh)
        own = FAMILY.get(c)
        if own in names and own in new.columns:
            other = F.col(f"n.{own}").isNotNull() & ~F.col(f"n.{own}").eqNullSafe(F.col(f"o.{own}"))
            return F.when(gone, was).when(same & ~other, F.coalesce(fresh, was)).otherwise(fresh)
        return F.when(gone, was).when(same, F.coalesce(fresh, was)).otherwise(fresh)

    return o.join(n, F.col("o.key") == F.col("n.key"), "full_outer").select(F.coalesce("o.key", "n.key").alias("key"), *[pick(c).alias(c) for c in names])


def prune(features: DataFrame, existing: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose asset still exists."""
    return features.join(existing.select(F.col(key).alias("key")), "key", "left_semi")


def info(features: DataFrame) -> DataFrame:
    """One row of counts; detection counts as there once the person flag is."""
    have = {"sha256": "with_sha256", "phash": "with_phash", "embedding": "with_embedding", "has_person": "with_detection"}
    return features.agg(F.count("*").alias("total_rows"), *[F.count(c).alias(n) for c, n in have.items() if c in features.columns])


def complete_detection(person: Column | str = "has_person", face: Column | str = "has_face") -> Column:
    """Detection is only complete when both flags are known."""
    return F.col(person).isNotNull() & F.col(face).isNotNull() if isinstance(person, str) else person.isNotNull() & face.isNotNull()


class FeatureTable:
    """The table on storage: a base v<n>, and what came after it as small commits c<n>-<k>.

    A commit writes only its own rows; reading merges the base with at most `most` commits, and the next one makes them
    into a new base. So a small batch doesn't rewrite the table, and a run that is broken off keeps its commits.
    There is one writer at a time; the base before the last, with its commits, stays for running readers."""

    def __init__(self, spark: SparkSession, path: str, most: int = 8):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def _names(self) -> list[str]:
        if not self._fs.exists(self._root):
            return []
        return [n for s in self._fs.listStatus(self._root) if self._fs.exists(self._path(f"{self.path}/{(n := s.getPath().getName())}/_SUCCESS"))]

    def _versions(self, names: list[str]) -> list[int]:
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _commits(self, names: list[str], version: int) -> list[int]:
        return sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"c{version}-") and n.rpartition("-")[2].isdigit())

    def _load(self, name: str) -> DataFrame:
        return conform(self.spark.read.parquet(f"{self.path}/{name}"), FEATURES)

    def read(self) -> DataFrame:
        names = self._names()
        version = (self._versions(names) or [0])[-1]
        rows = self._load(f"v{version}") if version else self.spark.createDataFrame([], FEATURES)
        for k in self._commits(names, version):
            rows = merge(rows, self._load(f"c{version}-{k}"))
        return rows

    def write(self, rows: DataFrame) -> None:
        """A new base."""
        versions = self._versions(self._names())
        target = (versions or [0])[-1] + 1
        conform(rows, FEATURES).write.mode("overwrite").parquet(f"{self.path}/v{target}")
        for s in self._fs.listStatus(self._root):
            name = s.getPath().getName()
            number = name[1:].partition("-")[0]
            if name[:1] in ("v", "c") and number.isdigit() and int(number) < target - 1:
                self._fs.delete(s.getPath(), True)

    def upsert(self, rows: DataFrame) -> None:
        """rows must have each key once."""
        names = self._names()
        version = (self._versions(names) or [0])[-1]
        commits = self._commits(names, version)
        if len(commits) >= self.most:
            self.write(merge(self.read(), conform(rows, FEATURES)))
        else:
            conform(rows, FEATURES).write.mode("overwrite").parquet(f"{self.path}/c{version}-{(commits or [0])[-1] + 1}")

    def prune(self, existing: DataFrame) -> int:
        now = self.read()
        kept = written(prune(now, existing), "pruned")
        removed = now.count() - kept.count()
        self.write(kept)
        return removed

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], FEATURES))

    def info(self) -> dict:
        size = self._fs.getContentSummary(self._root).getLength() / 1e6 if self._fs.exists(self._root) else 0.0
        return {"path": self.path} | info(self.read()).first().asDict() | {"size_mb": round(size, 2)}
