"""Connected components of an undirected graph given as an edge DataFrame.

Alternating large-star / small-star rounds (Kiveris, Lattanzi, Mirrokni, Rastogi,
Vassilvitskii, "Connected Components in MapReduce and Beyond", SoCC 2014): every round is a
group-by and a join, and the number of rounds grows with log(n), not with the graph's
diameter.  Each round's edges are written with ``checkpoint()`` (the shared folder of
``spark.checkpoint.dir``), which cuts the lineage and lets a lost executor be recovered
from the last written round instead of from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.session import ensure_checkpoint_dir


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    o = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    m = o.groupBy("u").agg(F.min("v").alias("m"))
    moved = o.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """True when every node has at most one outgoing edge and no node has both outgoing and
    incoming edges: the edges are then disjoint stars (node -> root), one per component,
    because every round keeps connectivity.  One aggregate job, exact."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        e.select(F.col("v").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    deg = ends.groupBy("n").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return deg.filter((F.col("o") > 1) | ((F.col("o") > 0) & (F.col("i") > 0))).isEmpty()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 200) -> DataFrame:
    """``(node, root)`` for every node that has an edge; ``root`` is the smallest node of its
    component.  Nodes without edges are not listed (they are their own root)."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    e = _small_star(e).checkpoint()
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        e = _small_star(_large_star(e)).checkpoint()
    else:
        raise RuntimeError("connected components did not converge")
    # at the fixed point every edge is (node, root) with root < node
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    members = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(roots)
