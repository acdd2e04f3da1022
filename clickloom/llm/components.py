"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.storage import discard, saved


def _to_lowest(pairs: DataFrame, node: str, other: str) -> DataFrame:
    """Each pair with the lowest of the node and all its partners.

    A minimum and a join on the node: a node of very many edges is combined
    before the shuffle, and adaptive execution may split its join.
    """
    lowest = pairs.groupBy(node).agg(F.least(F.first(node), F.min(other)).alias("low"))
    return pairs.join(lowest, node)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``; the component is its smallest node.

    Alternates the two star operations: every node first hands its larger
    neighbours to its smallest one, then all its neighbours that are not
    larger, until nothing changes. Each round is saved, and the one before deleted. Loops and repeated edges
    are allowed; no edges give no rows.
    """
    edges = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_lowest(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        small = _to_lowest(large, "u", "v")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            small.select("u", F.col("low").alias("v"))
        )
        last, edges = edges, saved(small.where("u <> v").distinct())
        discard(last)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
