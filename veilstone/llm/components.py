"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join back, so no node's links meet in one task;
the links of a round are written to the shared folder, which cuts the lineage and lets
executors be lost. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

MOST_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's least neighbour (itself included)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them. Links point from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links(u, v): root is the least node that it reaches. Empty links give no rows."""
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = work.written(links, "links")
    before = _state(links)
    if not before[0]:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MOST_ROUNDS):
        links = work.written(_small(_large(links)), "links")
        now = _state(links)
        if now == before:
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"links didn't settle within {MOST_ROUNDS} rounds")
