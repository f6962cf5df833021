"""Density clustering (DBSCAN semantics, cosine distance) as Spark joins and aggregates.

Labels equal those of a sequential DBSCAN that visits seeds in ``row_id`` order:

1. neighbours: pairs with distance <= eps in both directions, plus the point itself;
2. core points: at least ``min_size`` neighbours;
3. clusters: connected components of the core-core neighbour graph, numbered 0, 1, ... in
   the order of their smallest core ``row_id``;
4. border points: non-core points with a core neighbour take the smallest cluster number
   among those neighbours; all other points are noise (-1).

Every row is clustered (repeated texts count towards ``min_size``).

The neighbour pairs of a dense topic grow with the square of its size, so they never leave their task.
Pairs of blocks of vectors (see ``pivots``) are visited twice: first they emit one neighbour count per member,
then, knowing the core points, a spanning forest of their core points and the core neighbours of the
others, of which a point that is not core has fewer than ``min_size``.  Both are linear in the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators.blocks import similar_pairs
from feedlake.operators.components import connected_components
from feedlake.operators.pivots import PointGrid, compared, sides, tiles
from feedlake.operators.ranking import dense_index
from feedlake.session import ensure_checkpoint_dir

NOISE = -1


#: Share of near pairs of a tile from which it is handled as a matrix, not pair by pair.
DENSE = 1 / 16


def _neighbour_counts(eps: float, reach: float = 2.0, pivots=None, height: int = 2048):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """``(id, n)``: weight of the neighbours that each member has in the pair of blocks, itself left out."""
        counts: dict[int, tuple] = {}
        for left, right, x, y, sims in compared(key, rows, reach, pivots and pivots.value, height):
            for side in (left, right):
                counts.setdefault(id(side), (side, side.weight.to_numpy(np.float64), np.zeros(len(side))))
            (_, lw, ln), (_, rw, rn) = counts[id(left)], counts[id(right)]
            near = np.subtract(1.0, sims, out=sims) <= eps
            hits = np.flatnonzero(near)
            if len(hits) > DENSE * near.size:
                near = near.astype(np.float64)
                ln[x] += near @ rw[y]
                rn[y] += lw[x] @ near
            elif len(hits):
                at, to = np.divmod(hits, len(y))
                ln[x] += np.bincount(at, rw[y[to]], len(x))
                rn[y] += np.bincount(to, lw[x[at]], len(y))
        found = [pd.DataFrame({"id": side.id, "n": n}) for side, _, n in counts.values()]
        out = pd.concat(found) if found else pd.DataFrame({"id": [], "n": []})
        return out[out["n"] > 0].astype({"n": np.int64})

    return run


def _spanning_stars(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest id of its component) of the graph between ``left`` and ``right`` ids."""
    todo = near.any(1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while todo.any():
        rows, columns = np.zeros(len(left), bool), np.zeros(len(right), bool)
        fresh = np.zeros(len(left), bool)
        fresh[todo.argmax()] = True
        while fresh.any():
            rows |= fresh
            reached = near[fresh].any(0) & ~columns
            columns |= reached
            fresh = near[:, reached].any(1) & ~rows
        todo &= ~rows
        nodes = np.unique(np.concatenate([left[rows], right[columns]]))
        a.append(nodes[1:])
        b.append(np.full(len(nodes) - 1, nodes[0]))
    return np.concatenate(a), np.concatenate(b)


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``label`` (a member of its set for every member) after the sets of ``p`` and ``q`` are joined."""
    a, b = label[p], label[q]
    ties = np.unique((np.minimum(a, b) * len(label) + np.maximum(a, b))[a != b])
    if not len(ties):
        return label
    to = np.arange(len(label))
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while v in parent:
            if parent[v] in parent:
                parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for one, other in zip((ties // len(label)).tolist(), (ties % len(label)).tolist(), strict=True):
        one, other = root(one), root(other)
        if one != other:
            parent[max(one, other)] = min(one, other)
    for v in list(parent):
        to[v] = root(v)
    return to[label]


def _core_edges(eps: float, reach: float = 2.0, pivots=None, height: int = 2048):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """``(p, q, border)``: stars of connected core points (weight 1); and for each other member its
        core neighbours ``q``.  Core points that are connected already are not compared again."""
        left, right, one = sides(key, rows)
        lcore, rcore = left.weight.to_numpy() > 0, right.weight.to_numpy() > 0
        ids, core, second = (left.id, lcore, 0) if one else (np.concatenate([left.id, right.id]), np.concatenate([lcore, rcore]), len(left))
        label = np.arange(len(ids))
        border = [np.zeros((2, 0), np.int64)]

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return 1.0 - left.matrix[x] @ right.matrix[y].T <= eps

        for x, y in tiles(left, right, one, reach, pivots and pivots.value, height):
            xc, yc, xb, yb = x[lcore[x]], y[rcore[y]], x[~lcore[x]], y[~rcore[y]]
            if len(xc) and len(yc) and not ((label[xc] == label[xc[0]]).all() and (label[second + yc] == label[xc[0]]).all()):
                close = near(xc, yc)
                hits = np.flatnonzero(close)
                if len(hits) > DENSE * close.size:
                    label = _joined(label, *_spanning_stars(close, xc, second + yc))
                else:
                    at, to = np.divmod(hits, len(yc))
                    label = _joined(label, xc[at], second + yc[to])
            if len(xb) and len(yc):
                at, to = np.nonzero(near(xb, yc))
                border.append(np.stack([left.id[xb[at]], right.id[yc[to]]]))
            if len(xc) and len(yb):
                at, to = np.nonzero(near(xc, yb))
                border.append(np.stack([right.id[yb[to]], left.id[xc[at]]]))
        members = np.flatnonzero(core)
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label[members], ids[members])
        p, q = ids[members], smallest[label[members]]
        b = np.unique(np.concatenate(border, axis=1), axis=1)
        return pd.concat([pd.DataFrame({"p": p[p != q], "q": q[p != q], "border": False}), pd.DataFrame({"p": b[0], "q": b[1], "border": True})])

    return run


def tile_edges(points: DataFrame, eps: float, min_size: int, rows_per_block: int) -> tuple[DataFrame, DataFrame]:
    """(core points ``row_id``, edges ``(p, q, border)``) of points ``(vid, embedding, mult)``, for ``eps`` under 1, where
    a zero vector is a neighbour of its own copies only."""
    grid = PointGrid(points.select(F.col("vid").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("mult").alias("weight")), 1.0 - eps, rows_per_block)
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(grid.pivots)
    if grid.n:
        counts = grid.tiles().applyInPandas(_neighbour_counts(eps, grid.reach, shared, rows_per_block), "id long, n long").groupBy("id").agg(F.sum("n").alias("others"))
    else:
        counts = spark.createDataFrame([], "id long, others long")
    degree = points.select(F.col("vid").alias("id"), "mult").join(counts, "id", "left")
    known = (F.col("mult") + F.coalesce("others", F.lit(0)) >= min_size).cast("long")
    flagged = degree.select("id", known.alias("weight"), F.coalesce("others", F.lit(0)).alias("others")).checkpoint()
    core = flagged.filter("weight = 1").select(F.col("id").alias("row_id"))
    if not grid.n:
        return core, spark.createDataFrame([], "p long, q long, border boolean")
    linked = flagged.filter("others > 0").select("id", "weight")  # the rest has no neighbour
    return core, grid.tiles(linked).applyInPandas(_core_edges(eps, grid.reach, shared, rows_per_block), "p long, q long, border boolean").checkpoint()


def pair_edges(points: DataFrame, pairs: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """The same from given neighbour pairs ``(a, b)``."""
    mult = points.select("vid", "mult")
    both = pairs.select(F.col("a").alias("p"), F.col("b").alias("q")).union(pairs.select(F.col("b").alias("p"), F.col("a").alias("q"))).checkpoint()
    nbr = both.join(mult.withColumnRenamed("vid", "q"), "q").groupBy("p").agg(F.sum("mult").alias("others"))
    degree = mult.join(nbr.withColumnRenamed("p", "vid"), "vid", "left")
    core = degree.filter(F.col("mult") + F.coalesce("others", F.lit(0)) >= min_size).select(F.col("vid").alias("row_id"))
    to_core = both.join(core.withColumnRenamed("row_id", "q"), "q", "left_semi")
    flag = core.select(F.col("row_id").alias("p"), F.lit(False).alias("no"))
    return core, to_core.join(flag, "p", "left").select("p", "q", F.coalesce("no", F.lit(True)).alias("border"))


def density_clusters(
    df: DataFrame,
    eps: float = 0.4,
    min_size: int = 3,
    id_col: str = "row_id",
    vec_col: str = "embedding",
    rows_per_block: int = 2048,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """``(row_id, cluster, is_core)`` for every input row.

    Identical vectors are collapsed first (an aggregate, combined map-side) into one point
    with a multiplicity, so a group of copies - however large - yields no pairs among
    itself; copies still count towards ``min_size`` through the multiplicity, and all copies
    get the same label.  ``candidates`` (optional) is a DataFrame of ``(a, b)`` pairs of
    representative ids to test instead of all pairs (an approximate mode, e.g. from LSH);
    by default all pairs are tested exactly."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(vec_col).alias("embedding"))
    # one point per distinct vector: id = smallest row id of its copies
    points = (
        rows.filter(F.col("embedding").isNotNull())
        .groupBy("embedding")
        .agg(F.min("row_id").alias("vid"), F.count(F.lit(1)).alias("mult"))
        .checkpoint()
    )
    if candidates is not None:
        core, edges = pair_edges(points, candidates.select(F.col("a").cast("long"), F.col("b").cast("long")), min_size)
    elif eps < 1:
        core, edges = tile_edges(points, eps, min_size, rows_per_block)
    else:  # a zero vector is at distance 1 from all others, so distances say nothing about it
        core, edges = pair_edges(points, similar_pairs(points, "vid", "embedding", eps, "cosine", rows_per_block, by_distance=True), min_size)
    core_edges = edges.filter(~F.col("border"))
    comp = connected_components(core_edges, "p", "q")
    # core points without core neighbours are their own component
    core_root = core.join(comp.withColumnRenamed("node", "row_id"), "row_id", "left").select(
        "row_id", F.coalesce("root", "row_id").alias("root")
    )
    numbered = dense_index(core_root, "root", "cluster")
    core_label = core_root.join(numbered, "root").select("row_id", "cluster")
    border = (
        edges.filter("border")
        .join(core_label.withColumnRenamed("row_id", "q"), "q")
        .groupBy(F.col("p").alias("row_id"))
        .agg(F.min("cluster").alias("border_cluster"))
    )
    point_label = (
        points.select(F.col("vid").alias("row_id"), "embedding")
        .join(core_label.withColumn("is_core", F.lit(True)), "row_id", "left")
        .join(border, "row_id", "left")
        .select(
            "embedding",
            F.coalesce("cluster", "border_cluster", F.lit(NOISE)).cast("int").alias("cluster"),
            F.coalesce("is_core", F.lit(False)).alias("is_core"),
        )
    )
    # back to rows: one label row per distinct vector; AQE splits a hot vector's rows.  Rows
    # without a vector are kept, as noise.
    return rows.join(point_label, "embedding", "left").select(
        "row_id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def cluster_summary(labels: DataFrame) -> DataFrame:
    """One row: rows, clusters (noise excluded), noise rows, core rows."""
    return labels.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == NOISE).alias("n_noise"),
        F.count_if(F.col("is_core")).alias("n_core"),
    )


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def cluster_samples(labels: DataFrame, rows: DataFrame, per_cluster: int = 5, noise: int = 3) -> DataFrame:
    """First ``per_cluster`` rows of each cluster and first ``noise`` noise rows, in row order.
    ``row_number() <= n`` is limited per partition before the shuffle, so the noise group
    (which may hold most rows) never moves whole."""
    w = Window.partitionBy("cluster").orderBy("row_id")
    limit = F.when(F.col("cluster") == NOISE, F.lit(noise)).otherwise(F.lit(per_cluster))
    top = labels.select("row_id", "cluster").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= F.lit(max(per_cluster, noise)))
    return top.filter(F.col("rank") <= limit).join(rows, "row_id")
