"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import discard, looked_up, written

MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return looked_up(both.where("v > u"), least, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = looked_up(down, least, ["u"]).select("v", "m")
    return moved.union(least.select("u", "m")).toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the edges ``a, b``; the root is the smallest node that it reaches.

    Each round makes every node point at the least neighbour it knows (large star, then small star) and stores
    the edges in the shared folder; it ends when a round changes nothing, after about log(longest path) rounds.
    Minima reduce in each task before their shuffle, and a node with many edges is cut by the skew join: no
    node's edges meet in one task. Repeated edges and loops count once. Without edges the result is empty.
    """
    spark, last, path = edges.sparkSession, None, None
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(MOST_ROUNDS):
        stars = _small_star(_large_star(now).where("a <> b").distinct()).where("a <> b").distinct()
        stars, to = written(stars, "stars")
        if path:
            discard(spark, path)
        path, now = to, stars
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            # All edges now lead from a node to its root.
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(now.select(F.col("b"), F.col("b"))).distinct()
        last = mark
    raise RuntimeError(f"components: no end after {MOST_ROUNDS} rounds")
