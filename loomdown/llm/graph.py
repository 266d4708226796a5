"""Connected components of an edge table, by rounds of star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of (a, b) with an edge to another node.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest neighbour; the rounds end
    when the edges stop changing, after about log(nodes) of them. Minima are combined before the shuffle. Each round's
    edges are written, so that no lineage builds up, and those of the round before are released. The edges of a large
    star meet their one minimum in a join, which Spark splits where it is skewed.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now, old = written(small.where("a <> b").distinct(), "edges"), now
        release(old, large)
        last, seen = seen, mark(now)
        if seen == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
