"""Connected components of a graph whose edges are a Spark table."""

from pyspark.sql import functions as F

from rankloom.operators.sizing import stored


def _smallest(pairs):
    """``(u, m)``: the smallest neighbour of each node, the node itself included."""
    return stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-min")


def components(edges, a="a", b="b"):
    """``(node, component)``: the smallest node reachable, for each node with an edge to another.

    edges: pairs of longs in any order, repeats allowed; nulls and loops say nothing.
    Star contraction: in turn, every node links its larger neighbours, then its
    smaller ones and itself, to its smallest neighbour.  The number of edges never
    grows, and the number of rounds with the logarithm of the number of nodes.  Each
    round is written to the shared folder, so that lineage stays short, and no list
    of neighbours is ever gathered: only minima are grouped.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    links = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    links, before = stored(links, "components"), None
    while True:
        both = links.union(links.select("v", "u").toDF("u", "v"))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "components")
        joined = large.join(_smallest(large), "u")
        small = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        links = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "components")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
