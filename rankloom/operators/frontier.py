"""Pareto frontier of accuracy against throughput."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators.sizing import stored


def throughput(bench, n_queries):
    """Add ``throughput`` = queries per second, and ``accuracy``.  A time of 0 is infinite."""
    rate = F.when(F.col("time") == 0, F.lit(float("inf"))).otherwise(F.lit(n_queries) / F.col("time"))
    return bench.withColumn("throughput", rate).withColumn("accuracy", F.col("ndcg10"))


def pareto(points, range_rows=100_000, least_ranges=64, most_ranges=1024):
    """The points that no other point dominates.

    Dominated: some point is at least as good on both and better on one.  Equal
    points stay together; a point with no throughput or no accuracy stays.

    The points are read twice: once to keep the best accuracy of each throughput, which is
    stored and holds all that decides (map tasks reduce first, so a hot throughput is one
    row), and once to give out those that match a winner.  Between, the throughputs
    are cut into ranges; each range is held against the best accuracy of all faster ranges
    (one number per range), and what passes against the faster ones of its own range.
    """
    known = points.filter("throughput is not null and accuracy is not null")
    unknown = points.filter("throughput is null or accuracy is null")
    best = stored(known.groupBy("throughput").agg(F.max("accuracy").alias("accuracy")), "frontier")
    ranges = min(most_ranges, max(least_ranges, best.count() // range_rows))
    shares = [i / ranges for i in range(1, ranges)]
    finite = best.filter(F.col("throughput") < float("inf"))
    edges = sorted(set(finite.approxQuantile("throughput", shares, 0.5 / ranges)))
    best = best.withColumn("_range", _range_of(F.col("throughput"), edges))

    # One row per range.
    tops = best.groupBy("_range").agg(F.max("accuracy").alias("_top"))
    over = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_range", F.max("_top").over(over).alias("_beyond"))
    passing = best.join(F.broadcast(tops), "_range").filter("_beyond is null or accuracy > _beyond")
    faster = Window.partitionBy("_range").orderBy(F.desc("throughput")).rowsBetween(Window.unboundedPreceding, -1)
    winners = passing.withColumn("_faster", F.max("accuracy").over(faster))
    winners = winners.filter("_faster is null or accuracy > _faster").select("throughput", "accuracy")
    return known.join(winners, ["throughput", "accuracy"], "left_semi").select(*points.columns).unionByName(unknown)


def _range_of(col, edges, first=0):
    """How many edges are under col, by bisection."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    right = _range_of(col, edges[mid + 1 :], first + mid + 1)
    return F.when(col > edges[mid], right).otherwise(_range_of(col, edges[:mid], first))
