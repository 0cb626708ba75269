"""Rejection rules with precedence, as one ordered CASE each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.config import Config
from sievework.functions.expressions import _c


def quality_reason(config: Config, sharpness="sharpness", saturation="saturation", border="border_frac") -> Column:
    """blurry, then grayscale, then bordered; null metrics (unreadable assets) never reject."""
    never = F.lit(False)
    blurry = (_c(sharpness) < config.min_sharpness) if config.min_sharpness > 0 else never
    grey = (_c(saturation) <= config.grayscale_max_saturation) if config.drop_grayscale else never
    bordered = (_c(border) >= config.border_min_frac) if config.drop_bordered else never
    return F.when(blurry, "blurry").when(grey, "grayscale").when(bordered, "bordered")


def detection_reason(person: Column | str = "has_person", face: Column | str = "has_face") -> Column:
    """A person wins over a face."""
    return F.when(_c(person), "person").when(_c(face), "face")


def detection_flags(df: DataFrame, person: Column, face: Column) -> DataFrame:
    """has_person and has_face; the face is only looked for where there is no person (others get false)."""
    return df.withColumn("has_person", person).withColumn("has_face", F.when(F.col("has_person"), False).otherwise(face))


def detection_stats(df: DataFrame) -> DataFrame:
    person, face = F.coalesce("has_person", F.lit(False)), F.coalesce("has_face", F.lit(False))
    return df.agg(F.count_if(person).alias("people"), F.count_if(~person & face).alias("face_only"), F.count_if(~person & ~face).alias("clean"))


def screen_route(score: Column | str, threshold: float = 0.5) -> Column:
    """skipped without a score (null or NaN), blocked from the threshold on, else moved."""
    s = _c(score)
    return F.when(s.isNull() | F.isnan(s.cast("double")), "skipped").when(s >= threshold, "blocked").otherwise("moved")


def screen_summary(routes: DataFrame, threshold: float = 0.5, backend: str = "auto", route: str = "route") -> DataFrame:
    n = lambda x: F.count_if(F.col(route) == x).alias(x)
    return routes.agg(F.count("*").alias("total"), n("moved"), n("blocked"), n("skipped")).withColumn("threshold", F.lit(threshold)).withColumn("backend", F.lit(backend))


def surviving(df: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not rejected so far; repeated rows stay repeated."""
    return df.join(rejected.select(key), key, "left_anti")
