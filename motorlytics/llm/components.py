"""Connected components by alternating large-star and small-star steps.

Each step is a join-free aggregation over edges and written to the shared folder, so
a lost executor repeats one step at most. The number of steps grows with the logarithm
of the longest path. A vertex with very many edges is no hot group: the smallest
neighbour is a pre-aggregated minimum, joined back to the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlytics.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's larger (or its smaller) neighbours to its smallest neighbour or itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    rest = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, the component being its smallest
    node; only nodes with an edge appear. Loops and repeated or null edges do no harm."""
    now = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "cc-edges")
    mark = None
    while True:
        now = stored(_star(_star(now, True), False), "cc-edges")
        # a fixed point is a star forest: every edge ends in a vertex that is no edge's start
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = tuple(seen)
