"""Per-category samples in a reproducible order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_seed(df: DataFrame, category: str, item: str, categories: int, per_category: int, seed: int = 0) -> DataFrame:
    """At most `categories` categories, without replacement, and at most `per_category` items of each.

    Order is by the MD5 of seed and value, so a seed always gives the same sample. Names of chosen categories are
    a bounded list; items are ranked inside their category only."""
    draw = lambda c: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(c).cast("string")))
    chosen = df.select(category).where(F.col(category).isNotNull()).distinct().orderBy(draw(category), category).limit(categories)
    rank = F.row_number().over(Window.partitionBy(category).orderBy(draw(item), F.col(item)))
    return df.join(chosen, category, "left_semi").withColumn("rank", rank).where(F.col("rank") <= per_category)
