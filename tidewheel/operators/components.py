"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import checkpointed


def _least(edges: DataFrame, group: list[str]) -> DataFrame:
    """``edges`` with each ``u``'s smallest neighbour, itself included, as ``m``; a hub is an aggregate, never a list."""
    low = edges.groupBy(*group, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(low, [*group, "u"])


def components(edges: DataFrame, group: list[str], i: str = "i", j: str = "j") -> DataFrame:
    """``group..., node, component``: the smallest node that each node of an edge is connected with in its group.

    Large stars hang a node's larger neighbours on its smallest one, small stars the smaller ones and itself; when a round changes nothing,
    every node hangs on its component's smallest. The rounds are logarithmic in the number of nodes; each one's edges are
    stored. Nodes without an edge are not listed, loops and repeated edges do not matter, null ends are left out.
    """
    one = edges.select(*group, F.col(i).alias("u"), F.col(j).alias("v")).filter("u is not null and v is not null and u != v")
    now = checkpointed(one.select(*group, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(*group, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, group).filter("v > u").select(*group, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large, group)
        hung = small.filter("v != m").select(*group, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select(*group, "u", F.col("m").alias("v")))
        now = checkpointed(hung.distinct())
        # The same edges as a round before: counted, and compared by an order-free sum of hashes.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64(*group, "u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(*group, F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(*group, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
