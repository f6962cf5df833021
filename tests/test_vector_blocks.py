"""Copies of a vector that a pair join sends, and best earlier matches against a plain version."""

import numpy as np
import pytest

from feedlake.operators import pivots as P
from feedlake.operators.blocks import best_earlier_match, knn, similar_pairs
from feedlake.operators.clusters import _core_edges, _joined


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "row_id long, embedding array<double>").repartition(3)


def points_of(df):
    return df.selectExpr("row_id as id", "embedding", "cast(1 as long) as weight")


def test_copies_of_a_vector_do_not_grow_with_the_table(spark):
    rng = np.random.default_rng(0)
    for n in (600, 1800):
        grid = P.PointGrid(points_of(frame(spark, rng.normal(size=(n, 8)))), 0.1, rows_per_block=8)
        sent = P.spread(grid.placed, grid.pivots, grid.side(), grid.side(), grid.reach)
        assert sent.count() <= P.BLOCKS * n
        members = sent.groupBy("i", "j", "own").count().agg({"count": "max"}).first()[0]
        assert members <= 4 * n / P.BLOCKS + 8


def test_blocks_are_bounded_in_bytes():
    assert P.block_count(10, 64, 256) == 1
    assert P.block_count(100_000, 64, 128) == P.BLOCKS == P.block_count(1_000_000, 64, 128)
    assert P.block_count(100_000_000, 64, 128) * P.BLOCK_BYTES >= 100_000_000 * 64 * 8


def test_queries_and_rows_are_sent_to_few_blocks(spark):
    v = frame(spark, np.random.default_rng(4).normal(size=(900, 6)))
    hits = knn(v.selectExpr("row_id as query_id", "embedding"), v, k=3, threshold=0.1, exclude_self=True, max_broadcast_queries=0, rows_per_block=4)
    l2 = knn(v.selectExpr("row_id as query_id", "embedding"), v, k=3, metric="l2", threshold=None, exclude_self=True, max_broadcast_queries=0, rows_per_block=4)
    m = np.random.default_rng(4).normal(size=(900, 6))
    u = P.unit_rows(m)
    for got, sims in ((hits, u @ u.T), (l2, 1 - ((m[:, None] - m[None]) ** 2).sum(2))):
        np.fill_diagonal(sims, -np.inf)
        want = {(q, int(i)) for q in range(900) for i in np.argsort(-sims[q])[:3]}
        assert {(r.query_id, r.row_id) for r in got.collect()} == want


@pytest.mark.parametrize(("threshold", "width"), [(0.3, 0.8), (0.9, 0.2)])
def test_best_earlier_equals_plain(spark, threshold, width):
    rng = np.random.default_rng(6)
    v = np.concatenate([c + width * rng.normal(size=(40, 6)) for c in rng.normal(size=(5, 6))])
    v[rng.permutation(len(v))[:20]] = v[3]
    v[50] = 0
    v = v[rng.permutation(len(v))]
    u = P.unit_rows(v)
    want = {}
    for b in range(len(v)):
        sims = np.round(u[:b] @ u[b], 6)
        if len(sims) and sims.max() >= threshold:
            want[b] = int(np.argmax(sims))
    got = best_earlier_match(frame(spark, v), threshold, rows_per_block=16).collect()
    assert {r.query_id: r.match_id for r in got} == want and len(got) == len(want)


def test_vectors_without_finite_components_link_with_nothing(spark):
    v = np.random.default_rng(8).normal(size=(60, 4)) * 0.1 + 1
    v[5, 2] = np.nan
    v[9, 0] = np.inf
    got = P.similar_points(frame(spark, v), "row_id", "embedding", 0.5, rows_per_block=8).collect()
    sound = [i for i in range(60) if i not in (5, 9)]
    u = P.unit_rows(v[sound])
    assert len(got) == (np.triu(u @ u.T, 1) >= 0.5).sum() and not {r.a for r in got} & {5, 9}


def test_sets_are_joined():
    label = _joined(np.arange(6), np.array([0, 4, 5]), np.array([2, 5, 2]))
    assert label[0] == label[2] == label[4] == label[5] and len(set(label.tolist())) == 3


def test_core_edges_of_two_blocks():
    import pandas as pd

    rows = pd.DataFrame({"own": [True, True, False, False], "id": [1, 2, 3, 4], "weight": [1, 0, 1, 1], "embedding": [[1.0, 0.0], [0.0, 1.0], [0.999, 0.0447], [0.01, 0.99995]]})
    out = _core_edges(0.01)((0, 1), rows)
    assert sorted(map(tuple, out.itertuples(index=False))) == [(2, 4, True), (3, 1, False)]


def test_pairs_by_distance_do_not_depend_on_blocks(spark):
    df = frame(spark, np.random.default_rng(3).normal(size=(70, 3)))
    few = similar_pairs(df, "row_id", "embedding", 1.2, rows_per_block=8, by_distance=True).collect()
    one = similar_pairs(df, "row_id", "embedding", 1.2, n_blocks=1, by_distance=True).collect()
    assert {(r.a, r.b) for r in few} == {(r.a, r.b) for r in one} and len(few) == len(one)
