"""Density clusters, connected components and kNN on hand-made vectors."""

import math
import random

import pytest
from feedlake.operators.blocks import knn, similar_pairs
from feedlake.operators.clusters import cluster_summary, density_clusters
from feedlake.operators.components import connected_components
from feedlake.operators.ranking import dense_index


def unit(deg):
    r = math.radians(deg)
    return [math.cos(r), math.sin(r)]


def test_border_point_takes_lower_cluster(spark):
    degrees = [12, 21, 26, 28, 30, -6, -4, -2, 3, 90]
    df = spark.createDataFrame([(i, unit(d)) for i, d in enumerate(degrees)], "row_id long, embedding array<double>")
    got = {r.row_id: r.cluster for r in density_clusters(df, eps=0.0152, min_size=4, rows_per_block=3).collect()}
    assert [got[i] for i in range(10)] == [0, 0, 0, 0, 0, 1, 1, 1, 1, -1]


def test_zero_vector_and_all_noise(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "row_id long, embedding array<double>")
    labels = density_clusters(df, eps=0.1, min_size=2)
    got = {r.row_id: r.cluster for r in labels.collect()}
    assert got == {0: -1, 1: 0, 2: 0, 3: -1}
    s = cluster_summary(labels).first()
    assert (s.n_rows, s.n_clusters, s.n_noise) == (4, 1, 2)


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in range(n)}


def test_components_match_union_find(spark):
    rnd = random.Random(7)
    n = 300
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(260)]
    # a long chain: many rounds for plain label propagation
    edges += [(i, i + 1) for i in range(100, 160)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = union_find(n, edges)
    touched = {x for e in edges for x in e}
    for x in touched:
        assert got[x] == min(y for y in touched if want[y] == want[x])


def test_dense_index(spark):
    df = spark.createDataFrame([(v,) for v in [50, 7, 7, 3, 1000, 50, 12]], "v long").repartition(4)
    got = sorted((r.v, r["index"]) for r in dense_index(df, "v").collect())
    assert got == [(3, 0), (7, 1), (12, 2), (50, 3), (1000, 4)]


def test_pairs_symmetric_and_blocking_invariant(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    a = {(r.a, r.b) for r in similar_pairs(df, "row_id", "embedding", 0.5, n_blocks=1).collect()}
    b = {(r.a, r.b) for r in similar_pairs(df, "row_id", "embedding", 0.5, n_blocks=7).collect()}
    assert a == b and all(x < y for x, y in a)


@pytest.mark.parametrize("broadcast", [4096, 0])
def test_knn_ties_and_prefix(spark, broadcast):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    k2 = [r.row_id for r in knn(queries, corpus, k=2, max_broadcast_queries=broadcast, rows_per_block=2).orderBy("rank").collect()]
    k3 = [r.row_id for r in knn(queries, corpus, k=3, max_broadcast_queries=broadcast, rows_per_block=2).orderBy("rank").collect()]
    assert k2 == [1, 2] and k3[:2] == k2


def test_too_few_rows_is_all_noise(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "row_id long, embedding array<double>")
    assert {r.cluster for r in density_clusters(df, eps=0.4, min_size=3).collect()} == {-1}


def test_copies_count_towards_min_size(spark):
    # three copies of one vector form a core group alone; a fourth distinct point is noise
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.7071, 0.7071])]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    got = {r.row_id: (r.cluster, r.is_core) for r in density_clusters(df, eps=0.05, min_size=3).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (0, True), 4: (-1, False), 5: (-1, False)}


def test_missing_vector_is_noise(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    got = {r.row_id: r.cluster for r in density_clusters(df, eps=0.05, min_size=2).collect()}
    assert got == {1: 0, 2: 0, 3: -1}


def test_vector_copies_give_no_pairs(spark):
    from feedlake.operators.blocks import near_duplicate_vectors, vector_copies

    rows = [(i, [1.0, 0.0]) for i in range(1, 6)] + [(9, [0.99, 0.14])]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    assert {(r.a, r.b) for r in near_duplicate_vectors(df, 0.95).collect()} == {(1, 9)}
    assert {r.row_id: r.rep for r in vector_copies(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}
