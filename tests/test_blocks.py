"""Sweeps over blocks against brute force, and what they may hold, write and skip."""

import numpy as np
import pytest

from cleaveset.operators import blocks, pairwise


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<double>")


def all_distances(x, metric="euclidean"):
    return np.array([pairwise.exact(np.broadcast_to(r, x.shape), x, metric) for r in x])


def nearest_by_all(x, k, metric="euclidean", digits=9):
    d = blocks.away(all_distances(x, metric), digits)
    np.fill_diagonal(d, np.inf)
    order = [np.lexsort((np.arange(len(x)), r))[:k] for r in d]
    return {(i, p + 1): (int(j), d[i, j]) for i, o in enumerate(order) for p, j in enumerate(o)}


@pytest.mark.parametrize("d,metric", [(2, "euclidean"), (12, "euclidean"), (12, "cosine"), (3, "chebyshev")])
def test_nearest_by_brute_force_with_ties_and_copies(spark, d, metric):
    x = np.round(np.random.RandomState(d).randn(300, d) + 0.05, 1)
    x[200:250] = x[0]
    found = pairwise.nearest(table(spark, x), k=4, metric=metric, digits=9, block_rows=40).collect()
    assert {(r.id, r.place): (r.other, r.d) for r in found} == nearest_by_all(x, 4, metric)


def test_cells_keep_far_blocks_apart(spark):
    x = np.random.RandomState(1).rand(3000, 2) * 100
    own = blocks.Blocks(table(spark, x), block_rows=100)
    assert own.n == 3000 and own.k >= 20 and own.rows.max() <= 400
    met = [int((own.bounds(own, i)[0] <= 5).sum()) for i in range(own.k)]
    assert max(met) <= own.k // 2 and sum(met) <= own.k * own.k // 4


def test_rows_are_written_once_whatever_the_number_of_blocks(spark):
    x = np.random.RandomState(2).randn(600, 12)
    own = blocks.Blocks(table(spark, x), block_rows=30)
    assert own.k == 20 and sum(own.table(j).num_rows for j in np.flatnonzero(own.rows)) == 600
    meetings = [{i, j} for i in range(own.k) for j in own.partners(i)]
    assert len(meetings) == own.k * (own.k + 1) // 2 and len({frozenset(m) for m in meetings}) == len(meetings)


def components_by_all(near):
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None], len(near)).min(1))
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("d,radius", [(2, 0.12), (2, 1.5), (12, 2.2), (12, 4.0)])
def test_links_join_what_all_near_pairs_join_and_stay_few(spark, d, radius):
    from cleaveset.operators import graph

    x = np.random.RandomState(d).randn(400, d)
    near = all_distances(x) <= radius
    np.fill_diagonal(near, False)
    found = pairwise.links(table(spark, x), radius, block_rows=80).cache()
    assert found.count() <= 400 * 25 and (near.sum() < 10_000 or found.count() < near.sum() / 4)
    got = {r.id: r.component for r in graph.components(table(spark, x), found).collect()}
    assert [got[i] for i in range(400)] == components_by_all(near).tolist()


def test_dbscan_by_its_definition_without_a_row_a_pair(spark, monkeypatch):
    from cleaveset.operators import cluster

    monkeypatch.setattr(pairwise, "edges", None)  # pairs are never rows
    rng = np.random.RandomState(3)
    x = np.concatenate([rng.randn(60, 2) * 0.3 + c for c in ((0, 0), (4, 0), (1.4, 1.4))] + [rng.rand(60, 2) * 8 - 2])
    near = all_distances(x) <= 0.3
    core = near.sum(1) >= 5
    label = components_by_all(near & core[None] & core[:, None])
    number = {r: i for i, r in enumerate(sorted(set(label[core])))}
    want = [number[label[i]] if core[i] else min((number[label[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]
    got = {r.id: r.cluster for r in cluster.dbscan(table(spark, x), 0.3, 5).collect()}
    assert [got[i] for i in range(len(x))] == want and -1 in want and any(not core[i] and want[i] >= 0 for i in range(len(x)))


@pytest.mark.parametrize("thresholded,guard", [(True, 0.0), (False, 1e-10)])
def test_spectral_scores_beyond_the_dense_kernel(spark, thresholded, guard):
    from cleaveset.operators import graph

    x = np.concatenate([np.random.RandomState(4).randn(150, 12), np.random.RandomState(5).randn(100, 12) + 0.7])
    df = table(spark, x)
    dense, swept = ({r.id: r.score for r in graph.spectral_scores(df, thresholded=thresholded, guard=guard, dense_rows=n).collect()} for n in (250, 249))
    assert sorted(swept) == list(range(250)) and max(abs(dense[i] - swept[i]) for i in dense) < 1e-7


@pytest.mark.parametrize("seed,spread,threshold", [(6, 0.0, None), (7, 9.0, 1e-9), (8, 9.0, None)])
def test_minimum_cut_beyond_the_dense_kernel(spark, seed, spread, threshold):
    from cleaveset.operators import graph

    rng = np.random.RandomState(seed)
    df = table(spark, np.concatenate([rng.randn(60, 3), rng.randn(45, 3) * 0.8 + spread]))
    dense, swept = (sorted((r.id, r.split) for r in graph.min_cut_sides(df, 0.7, threshold, dense_rows=n).collect()) for n in (105, 104))
    assert dense == swept and len(dense) == 105


def test_discrepancy_holds_no_square_matrix():
    import tracemalloc

    from cleaveset.operators import kernels

    x = np.random.RandomState(9).randn(3000, 8)
    train = np.arange(3000) % 10 < 7
    tracemalloc.start()
    after = kernels.Discrepancy(20)(x, train.copy(), np.random.RandomState(0), np.arange(3000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert after.sum() == train.sum() and most < 3000 * 3000 * 8 / 2
