"""Connected components by alternating large-star and small-star, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Edges that one task writes in a round; a round over few edges is not spread over many small files.
ROWS_OF_A_TASK = 200_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(neighbours: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least node among u and its neighbours. The aggregate is partial, the join is split if skewed."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return neighbours.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    s = _star(_both(edges)).where("v > u")
    return s.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    s = _star(down)
    return s.select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that every node of an edge can reach. edges: (u, v), no nulls; loops are ignored.

    Each round is written to the shared folder, so lineage stays short and a lost executor repeats one round at most.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:  # the two stars converge for every graph; a path of n nodes takes about log(n) rounds
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = tuple(mark)
        parts = min(int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")), mark[0] // ROWS_OF_A_TASK + 1)
        now = stored(small_star(large_star(now)).coalesce(parts), "edges")
