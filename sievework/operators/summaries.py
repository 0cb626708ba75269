"""One-row summaries, each in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.config import REASONS


def run_summary(outcomes: DataFrame, reason: str = "reason") -> DataFrame:
    """outcomes has a row for each input; a null reason is a survivor."""
    short = {"duplicate_exact": "exact_dup", "duplicate_near": "near_dup"}
    counts = [F.count_if(F.col(reason) == r).alias(f"rejected_{short.get(r, r)}") for r in REASONS]
    return outcomes.agg(F.count("*").alias("total_input"), *counts, F.count_if(F.col(reason).isNull()).alias("survivors"))


def dedup_summary(outcomes: DataFrame, reason: str = "reason") -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    r = F.col(reason)
    return outcomes.agg(F.count("*").alias("total"), n(r == "duplicate_exact", "rejected_exact"), n(r == "duplicate_near", "rejected_near"), n(r.isNull(), "survivors"))


def gallery_counts(outcomes: DataFrame, reason: str = "reason") -> DataFrame:
    return outcomes.agg(F.count_if(F.col(reason).isNull()).alias("kept"), F.count_if(F.col(reason).isNotNull()).alias("rejected"))
