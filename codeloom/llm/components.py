"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b: long); root is the smallest node of its component.

    Each round links larger neighbours to the smallest one, then smaller ones, and is written as a table,
    so lineage stays short. Minima are partial sums' cousins (combined before the shuffle) and the joins
    have one row per node on one side, so a hub only makes the other side heavy, which AQE splits.
    """
    now = as_table(_down(edges))
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not seen.n or seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b")).distinct()
        mark = seen
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = as_table(_down(small.select("a", F.col("m").alias("b")).union(
            small.where("b <> m").select("b", "m"))))
