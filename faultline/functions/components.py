"""Connected components of an edge table by alternating star contraction.

Every node is linked to its smallest neighbour until nothing changes; each component then is
a star around its smallest node.  Rounds are logarithmic in the longest path, each is a
pre-aggregated ``groupBy`` and a join, and its result is a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import BROADCAST_ROWS, materialize, shuffled


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(shuffled(least) if many else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(shuffled(least) if many else least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) for each node that has an edge to another.

    Null ends and self-loops are ignored; repeated edges and both directions do not matter."""
    now = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        many = mark[0] > BROADCAST_ROWS                 # else Spark may broadcast, at most two rows an edge
        after = materialize(_small_star(_large_star(now, many), many), "edges")
        moved = _mark(after)
        now, same = after, moved == mark
        mark = moved
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
