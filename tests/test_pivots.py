"""Pivot joins and linear-output clustering against plain versions."""

import numpy as np
import pandas as pd
import pytest

from feedlake.operators import clusters as C
from feedlake.operators import pivots as P
from feedlake.operators.blocks import knn
from feedlake.operators.clusters import density_clusters


def clustered(rng, centres, each, width, dim=8):
    middle = rng.normal(size=(centres, dim))
    return np.concatenate([m + width * rng.normal(size=(each, dim)) for m in middle])


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "row_id long, embedding array<double>").repartition(3)


def unit(v):
    return P.unit_rows(np.asarray(v, float))


@pytest.mark.parametrize(("threshold", "width"), [(0.95, 0.05), (0.5, 0.6), (0.999999, 1e-5), (1e-9, 1.0)])
def test_no_pair_is_lost(spark, threshold, width):
    v = clustered(np.random.default_rng(1), 6, 40, width)
    v[7] = 0
    v[8] = v[9] * 3
    sims = unit(v) @ unit(v).T
    want = {(a, b) for a, b in zip(*np.nonzero(sims >= threshold), strict=True) if a < b}
    got = P.similar_points(frame(spark, v), "row_id", "embedding", threshold, rows_per_block=16).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def points_of(df):
    return df.selectExpr("row_id as id", "embedding", "cast(1 as long) as weight")


def test_tiles_are_left_out_where_vectors_are_clustered(spark):
    v = clustered(np.random.default_rng(2), 20, 30, 0.02)
    grid = P.PointGrid(points_of(frame(spark, v)), 0.95, rows_per_block=30)
    assert grid.skipped() > 0.8
    loose = P.PointGrid(points_of(frame(spark, np.random.default_rng(2).normal(size=(600, 8)))), 0.2, rows_per_block=30)
    assert loose.skipped() <= grid.skipped()
    members = grid.placed.groupBy("cell", "part").count()
    assert members.agg({"count": "sum"}).first()[0] == 600


def test_a_large_cell_is_dealt_to_parts(spark):
    v = 1 + 0.001 * np.random.default_rng(3).normal(size=(400, 4))
    grid = P.PointGrid(points_of(frame(spark, v)), 0.9, rows_per_block=20)
    assert grid.placed.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] < 80


def plain_clusters(v, eps, min_size):
    """Sequential DBSCAN, seeds in row order; a border point goes to the first cluster that reaches it."""
    near = 1 - unit(v) @ unit(v).T <= eps
    near |= (np.asarray(v)[:, None] == np.asarray(v)[None]).all(2)  # copies, also of a zero vector
    core = near.sum(1) >= min_size
    label = np.full(len(v), -1)
    cluster = 0
    for seed in range(len(v)):
        if not core[seed] or label[seed] >= 0:
            continue
        stack = [seed]
        label[seed] = cluster
        while stack:
            at = stack.pop()
            if core[at]:
                for other in np.flatnonzero(near[at] & (label < 0)):
                    label[other] = cluster
                    stack.append(other)
        cluster += 1
    return {i: (int(label[i]), bool(core[i])) for i in range(len(v))}


@pytest.mark.parametrize(("eps", "min_size", "width"), [(0.02, 4, 0.1), (0.4, 3, 0.6), (0.1, 6, 0.35), (1e-9, 1, 0.5)])
def test_labels_equal_sequential_ones(spark, eps, min_size, width):
    v = clustered(np.random.default_rng(5), 5, 30, width, dim=4)
    got = {r.row_id: (r.cluster, r.is_core) for r in density_clusters(frame(spark, v), eps, min_size, rows_per_block=12).collect()}
    assert got == plain_clusters(v, eps, min_size)


def test_zero_vectors_at_eps_under_and_over_one(spark):
    v = np.array([[0, 0], [0, 0], [1, 0], [0, 1], [-1, 0]], float)
    for eps in (0.5, 1.0, 1.5):
        got = {r.row_id: r.cluster for r in density_clusters(frame(spark, v), eps, 2).collect()}
        assert got == {i: c for i, (c, _) in plain_clusters(v, eps, 2).items()}, eps


def test_a_dense_topic_emits_rows_in_proportion(spark):
    rows = {}
    for m in (100, 200, 400):
        v = 1 + 0.01 * np.random.default_rng(m).normal(size=(m, 6))
        points = frame(spark, v).selectExpr("row_id as vid", "embedding", "cast(1 as long) as mult")
        core, edges = C.tile_edges(points, 0.05, 3, rows_per_block=2048)
        assert core.count() == m
        rows[m] = edges.count()
    assert rows[400] <= 4.5 * rows[100] and rows[400] < 400 * 40  # all pairs: 79,800


def test_stars_span_components():
    near = np.array([[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]], bool)
    a, b = C._spanning_stars(near, np.array([10, 11, 12, 13]), np.array([20, 21, 22, 23]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(11, 10), (20, 10), (21, 10), (23, 12)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "row_id long, embedding array<double>")
    assert P.similar_points(none, "row_id", "embedding", 0.9).collect() == []
    assert density_clusters(none, 0.3, 2).collect() == []
    counted = C._neighbour_counts(0.1)((0, 0, 1, 0), pd.DataFrame({"own": [True], "id": [1], "weight": [1], "embedding": [[1.0]]}))
    assert not len(counted)


@pytest.mark.parametrize(("k", "threshold", "width"), [(1, 0.01, 0.5), (3, 0.2, 1.0), (5, 0.97, 0.05), (7, 0.5, 0.3)])
def test_nearest_rows_equal_plain(spark, k, threshold, width):
    v = clustered(np.random.default_rng(9), 5, 40, width)
    v[3] = 0
    v[10] = v[11]
    corpus = spark.createDataFrame([(i, [float(x) for x in e], i % 4 or None) for i, e in enumerate(v)], "row_id long, embedding array<double>, level int").repartition(4)
    queries = corpus.filter("row_id % 3 = 0").selectExpr("row_id as query_id", "embedding")
    got = knn(queries, corpus, k=k, threshold=threshold, exclude_self=True, max_broadcast_queries=0, rows_per_block=16).collect()
    sims = np.round(unit(v) @ unit(v).T, 12)
    want = set()
    for q in range(0, len(v), 3):
        best = sorted((-sims[q, i], i) for i in range(len(v)) if i != q and sims[q, i] >= threshold)[:k]
        want |= {(q, i, i % 4 or None, rank) for rank, (_, i) in enumerate(best, 1)}
    assert {(r.query_id, r.row_id, r.level, r["rank"]) for r in got} == want and len(got) == len(want)
