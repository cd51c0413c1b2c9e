"""Connected components of a graph of any size, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainscope.session import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(a, b)``; the root is the smallest vertex of its component.

    Alternates the two star steps of Kiveris et al. until the edges stay the same.  Each step is an
    aggregation and a join on the vertex, so a vertex with very many edges is combined before the
    shuffle and split by the skew join.  Every round is written to the shared folder and read back.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = _kept(now)
    while mark[0]:
        now, new = _kept(_small_star(_large_star(now)))
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = stored(edges, "components")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges, tuple(mark)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
