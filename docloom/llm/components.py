"""Connected components of a link table, by alternating large and small stars.

Links of one node never meet in one task: a minimum per node (combined before the shuffle) is joined back to
the links, and the adaptive skew join may split a node that holds many of them. Every round is written to the
shared checkpoint folder. The number of rounds grows with the logarithm of the size, not the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _with_min(sides: DataFrame) -> DataFrame:
    """sides(u, v) -> (u, v, m): m is the least of u and all its v."""
    least = materialize(sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return sides.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_min(down)
    return starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (u, v): every linked node u with the least node v it can reach; v itself is not listed."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        edges = materialize(small_star(large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges
        seen = now
    raise RuntimeError("the stars did not settle")
