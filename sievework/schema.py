"""Schemas of the tables a run reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "binary": T.BinaryType(), "array<bigint>": T.ArrayType(T.LongType()), "array<float>": T.ArrayType(T.FloatType()),
}


def struct(columns: str) -> T.StructType:
    """From "name type, ..."; usable before there is a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


ASSETS = struct("path string, root string, rel_path string, size bigint, mtime double")
FEATURES = struct(
    "key string, path string, size bigint, mtime double, sha256 string, phash array<bigint>, has_person boolean, has_face boolean, "
    "unsafe_score double, embedding array<float>, sharpness double, saturation double, border_frac double, sharpness_full double, "
    "readable boolean, params string, unsafe_params string, updated_at timestamp"
)
#: The columns whose values depend on options, under the column that says which options those were.
FAMILIES = {"params": ("sha256", "phash", "has_person", "has_face", "embedding", "sharpness", "saturation", "border_frac", "sharpness_full", "readable"), "unsafe_params": ("unsafe_score",)}
OUTCOMES = struct("rel_path string, reason string, original_path string")
MANIFEST = struct("index bigint, filename string, original_path string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema, in its order and types; what is missing is null (tables written before a column was added)."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
