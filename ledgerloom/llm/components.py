"""Connected components by alternating stars, as DataFrame joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)).alias("s")).first()
    return row["n"], row["s"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), where component is the least node reachable.

    Nodes may be of any type with an order. Each round links every larger neighbour of a node to its least neighbour
    (large star), then every smaller one and the node itself (small star), until nothing changes; the number of rounds
    grows with the logarithm of the longest path. A node's neighbours are never gathered: the least is a partial
    aggregate, and the joins read written tables on both sides, so that adaptive execution can split a hot node.
    Links of a node to itself or with a null end count for nothing; no links give no rows.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stage(now, "stars")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = stage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "stars")
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        # a node's larger neighbours go to its least one; u > v always, as v is at most x
        large = stage(large.distinct(), "stars")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = stage(small.distinct(), "stars")
        mark = _fingerprint(after)
        if mark == seen:
            break
        now, seen = after, mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
