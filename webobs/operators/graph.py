"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webobs.runtime import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) for every node of edges (a, b): comp is the smallest id of its component.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014): every step is an equi-key aggregate and join,
    edges shrink to stars, and a reliable checkpoint cuts the lineage each round. Null ends and loops are ignored (a node
    with only loops is no node here); repeated edges count once; an empty table gives an empty result. Raises if not
    settled after `rounds` rounds (each at least halves the depth, so 60 is out of reach).
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = cut(e)
    for _ in range(rounds):
        # Large-star: neighbours above a node are linked to its smallest neighbour (or itself).
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # Small-star: a node and its smaller neighbours are linked to the smallest of them.
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        nxt = big.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u > v").distinct()
        nxt = cut(nxt)
        # Settled when every node has one edge and no node is both an end and a centre.
        n = nxt.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if n["n"] == n["d"] and nxt.join(nxt.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return nxt.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(nxt.select("v", "v").distinct())
        e = nxt
    raise RuntimeError("components did not settle")
