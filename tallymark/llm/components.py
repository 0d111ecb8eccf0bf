"""Connected components by alternating large-star and small-star steps, in DataFrame operations only.

Each step joins edges with one row a node (its least neighbour), so a hub's edges
may be split by AQE's skew join; nothing is gathered by component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, both.a == least.k).filter("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges come as a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m")
    joined = edges.join(least, edges.b == least.k)
    moved = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("k").alias("b"))).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """One row ``(node, component)`` for each node of an edge that isn't a loop; ``component`` is the least node reachable.

    Node columns may be of any ordered type. Nulls and loops are ignored; repeated edges count once; no edges give no rows.
    Rounds grow with the logarithm of the longest path; each is written to the shared folder.
    """
    now = written(edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), F.col(left).isNotNull().alias("l"), F.col(right).isNotNull().alias("r")).filter("l and r and a < b").select("a", "b").distinct(), "edges")
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    before = now.agg(sign.alias("x")).first()["x"]
    while before["n"]:
        now = written(_small(_large(now)), "edges")
        after = now.agg(sign.alias("x")).first()["x"]
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
