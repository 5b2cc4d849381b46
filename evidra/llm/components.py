"""Connected components of links as Spark joins: alternating large-star and small-star rounds.

Every round halves the distances at least, and ends in stars whose centre is the smallest node of each component. Each
round's edges are written to the shared folder, so plans stay short and no executor's loss repeats earlier rounds.
Minima are combined before shuffles. A hub's edges never meet its minimum in one task: nodes with more than a
1/HUBS share of all edges are at most HUBS, so their minima are broadcast and their edges stay where they are; the edges of all
other nodes are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import cut, drop

HUBS = 1024


def are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    by = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return by.where("out > 1 OR (out > 0 AND in > 0)").isEmpty()


def minima(edges: DataFrame) -> tuple[DataFrame, int]:
    """(u, m, k): the smallest v of each u and its number of edges, as a table; and how many edges make a hub."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "minima")
    return least, (least.agg(F.sum("k")).first()[0] or 0) // HUBS + 1


def with_minimum(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """edges with the m of their u."""
    hubs = F.broadcast(least.where(F.col("k") >= hub).select("u", "m"))  # HUBS rows at most
    marked = edges.join(hubs, "u", "left")
    rest = marked.where("m IS NULL").drop("m").join(least.where(F.col("k") < hub).select("u", "m"), "u")
    return marked.where("m IS NOT NULL").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component), component the smallest node reachable, for every node of the edges (a, b); a cut table."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, hub = minima(both)
        large = cut(with_minimum(both, least, hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large")
        small, hub = minima(large)
        stay = with_minimum(large, small, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(stay.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now, least, large, small)
        now = after
    found = cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop(now)
    return found
