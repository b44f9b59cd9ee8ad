"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _lowest(ends: DataFrame) -> DataFrame:
    """(a, m): the smallest neighbour of each node, as a written table.

    Because it is written, the join with it has plain shuffles on both sides,
    and adaptive execution can split the edges of a hub over tasks.
    """
    return cut(ends.groupBy("a").agg(F.min("b").alias("m")), "low")


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both)
    out = both.join(low, "a").where("b > a")
    return out.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct(), low


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down)
    out = down.join(low, "a")
    pairs = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return pairs.where("a <> b").distinct(), low


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest reachable node.

    Alternates the large-star and small-star steps until the edges stay as
    they are, which is when every edge points from a node to its component's
    smallest node; there is no limit to the number of steps, which grows with
    the logarithm of the longest chain. A step costs one pre-aggregated
    shuffle and one join; no component is ever gathered in one place. Null
    ends are ignored; an empty table gives an empty table. Each step is
    written to the shared folder, so the plan stays short and a lost
    executor costs at most one step.
    """
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = cut(e, "edges")
    state = None
    while not e.isEmpty():
        before = e
        large, low = _large_star(e)
        large = cut(large, "large")
        discard(low)
        small, low = _small_star(large)
        e = cut(small, "edges")
        discard(before, large, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component")).distinct()
