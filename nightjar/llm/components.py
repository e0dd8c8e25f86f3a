"""Connected components of an edge table by alternating star contraction.

Each round hangs every node's neighbours on its smallest neighbour, first the
larger ones, then the smaller ones; the number of rounds grows with the
logarithm of the longest path.  Edges are written between rounds, so a lost
executor costs one round, and hubs are split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import materialise


def _hang(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on (u, v) pairs: v in u's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least", narrow=True)
    if larger:
        out = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (both.where("v < u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.where("u != m").select("u", F.col("m").alias("v")))
               .groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"))
    return materialise(out, "edges", narrow=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the (u, v) edges; root is the smallest
    node of the component.  Nulls and loops are ignored."""
    edges = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")),
                        "edges", narrow=True)
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if not now[0] or now == mark:
            break
        mark = now
        edges = _hang(_hang(edges, True), False)
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(edges.select(F.col("v"), F.col("v")).distinct()))
