"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sievework.plans.scratch import discard, written


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the lowest of u and all its v. The minimum is pre-aggregated; a hub's join is split at run time."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(low, "u")


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("v", "u"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge; the component is its lowest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) contract long chains in a logarithmic
    number of rounds, each a pre-aggregated minimum and an equi join. Loops and repeated edges are allowed, and
    edges with a null end are ignored. A round's edges are written to the shared folder.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u").distinct()
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")]

    def kept(edges: DataFrame) -> tuple[DataFrame, dict]:
        """The edges, written, and a checksum that is taken on the way."""
        seen = Observation()
        return written(edges.observe(seen, *mark), "edges"), seen.get

    stars, last = kept(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        large = _lowest(_both(stars)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _lowest(large.where("v < u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, (stars, now) = stars, kept(small)
        discard(before)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = stars.select(F.col("v").alias("u")).union(loops).distinct().join(stars.select("u"), "u", "left_anti")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("u", "u"))
