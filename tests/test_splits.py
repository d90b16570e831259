import hashlib

import numpy as np
import pytest

from cleaveset.operators import cluster, embedding, graph, kernels, metrics, pairwise, splits
from cleaveset.sources import generators


@pytest.fixture(scope="module")
def points(spark):
    df = generators.make_bimodal(spark, 120).cache()
    df.count()
    return df


def sides(df):
    rows = df.collect()
    return {r.id for r in rows if r.split == "train"}, {r.id for r in rows if r.split == "test"}, len(rows)


EXACT = ("random_split", "distance_adversarial_split", "density_adversarial_split", "outlier_adversarial_split", "min_cut_split", "normalized_cut_split", "neighbor_coverage_split", "centroid_matched_split", "nearest_neighbor_split", "max_coverage_split", "distribution_matched_split", "moment_matched_split", "histogram_matched_split", "mmd_minimized_split")


@pytest.mark.parametrize("name", list(splits.get_splitters()))
def test_every_splitter_covers(points, name):
    train, test, n = sides(splits.get_splitters()[name](points))
    assert n == 120 and not train & test and train | test == set(range(120))
    if name in EXACT:
        assert len(train) == 84


@pytest.mark.parametrize("kernel,score", [(kernels.Centroids(100), 0), (kernels.Moments(200), 0), (kernels.Distribution(200), 0), (kernels.Histograms(200), 0), (kernels.Discrepancy(200), 0)])
def test_hill_climbs_lower_their_objective(kernel, score):
    rng = np.random.RandomState(1)
    x = rng.randn(80, 3)
    train = np.arange(80) < 56
    kernel.start(x, train)
    before = kernel.value()
    after = kernel(x, train, np.random.RandomState(0), np.arange(80))
    kernel.start(x, after)
    assert kernel.value() < before and after.sum() == 56


def test_discrepancy_matches_its_definition():
    rng = np.random.RandomState(2)
    x, train = rng.randn(30, 2), np.arange(30) < 20
    climb = kernels.Discrepancy(1)
    climb.start(x, train)
    climb.swap(3, 25)
    train[3], train[25] = False, True
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    k = np.exp(-d / 2)
    want = k[np.ix_(train, train)].mean() + k[np.ix_(~train, ~train)].mean() - 2 * k[np.ix_(train, ~train)].mean()
    assert climb.value() == pytest.approx(want)


def test_blocks_match_brute_force(spark, points):
    rows = {r.id: np.array(r.e) for r in points.collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    off = d[~np.eye(len(d), dtype=bool)]
    for q in (0.1, 0.5):
        assert pairwise.pair_quantile(points, q, block_rows=50) == pytest.approx(np.quantile(off, q))
        assert pairwise.pair_quantile(points, q, block_rows=50, most=10) == pytest.approx(np.quantile(off, q))
    near = {(r.id, r.place): r.other for r in pairwise.nearest(points, k=3, block_rows=50).collect()}
    np.fill_diagonal(d, np.inf)
    for i in ids:
        assert [near[i, p] for p in (1, 2, 3)] == list(np.argsort(d[i], kind="stable")[:3])
    n = {r.id: r.n for r in pairwise.within(points, 1.0, block_rows=50).collect()}
    assert all(n[i] == (d[i] <= 1.0).sum() for i in ids)
    np.fill_diagonal(d, 0)
    for metric in ("cityblock", "chebyshev", "sqeuclidean", "cosine"):
        got = {(r.a, r.b): r.d for r in pairwise.pairwise_distances(points.where("id < 6"), metric).collect()}
        u, v = x[0], x[5]
        want = {"cityblock": np.abs(u - v).sum(), "chebyshev": np.abs(u - v).max(), "sqeuclidean": ((u - v) ** 2).sum(), "cosine": 1 - u @ v / np.linalg.norm(u) / np.linalg.norm(v)}[metric]
        assert len(got) == 36 and got[0, 5] == pytest.approx(want)


def test_components_and_dbscan(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 3), (5, 4), (7, 8), (8, 7)], "a long, b long")
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}
    line = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 0.1, 0.2, 5, 5.1, 5.2, 50])], "id long, e array<double>")
    found = {r.id: r.cluster for r in cluster.dbscan(line, 0.15, 2).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: -1}
    train, test, _ = sides(splits.cluster_split(line, method="dbscan", eps=0.15, min_samples=2))
    assert 6 in test


def test_minimum_cut():
    w = np.zeros((6, 6))
    for a, b, x in [(0, 1, 3), (1, 2, 3), (0, 2, 3), (3, 4, 3), (4, 5, 3), (3, 5, 3), (2, 3, 1)]:
        w[a, b] = w[b, a] = x
    assert sorted(graph.stoer_wagner(w)) in ([0, 1, 2], [3, 4, 5])


def test_edges_of_the_domain(spark, points):
    empty = spark.createDataFrame([], "id long, e array<double>")
    assert embedding.distance_to_mean(empty).collect() == [] and embedding.local_density(empty).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, e array<double>")
    assert embedding.distance_to_nearest_neighbor(one).first().score == float("inf")
    with pytest.raises(ValueError):
        splits.cluster_split(points, method="unknown")
    with pytest.raises(ValueError):
        splits.mmd_minimized_split(points, kernel="unknown")
    with pytest.raises(ValueError):
        splits.get_splitters("unknown")
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], "id long, e array<double>")
    assert sides(splits.normalized_cut_split(same))[2] == 6


def test_report(points):
    r = metrics.split_similarity(points.join(splits.random_split(points), "id").select("id", "e", "split")).first()
    assert 0 <= r.coverage <= 1 and r.mean_nearest > 0


def test_groups_of_bounded_size(points):
    found = kernels.run_groups(points.select("id", "e"), kernels.Centroids(20), 0.7, 42, group_rows=30)
    train, test, n = sides(found)
    assert n == 120 and abs(len(train) - 84) <= 4


def start_of(ids, seed=42, ratio=0.7):
    order = sorted(range(len(ids)), key=lambda i: hashlib.md5(f"{ids[i]}:{seed}".encode()).hexdigest())
    train = np.zeros(len(ids), bool)
    train[order[: int(len(ids) * ratio)]] = True
    return train


def test_nearest_neighbours_are_those_of_all_rows(spark):
    rng = np.random.RandomState(3)
    x = rng.rand(2200, 2)
    df = spark.createDataFrame([(i + 3000 * c, p.tolist()) for c in (0, 1) for i, p in enumerate(x)], "id long, e array<double>")
    train, test, n = sides(splits.nearest_neighbor_split(df))
    assert n == 4400 and len(train) == int(4400 * 0.7) and all((i + 3000 if i < 3000 else i - 3000) in train for i in test)


def test_coverage_counts_all_rows(spark):
    rng = np.random.RandomState(4)
    x = np.round(rng.rand(2300, 2) * 1000, 1)  # pairs of near copies far from the others
    e = np.concatenate([x, x + 0.01])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(e)], "id long, e array<double>")
    train, test, n = sides(splits.max_coverage_split(df, radius=0.02))
    assert n == 4600 and len(train) == int(4600 * 0.7) and all((i + 2300) % 4600 in train for i in test)
    e = np.concatenate([rng.randn(4490, 1), rng.randn(10, 1) + 1000 * np.arange(1, 11)[:, None]])  # far from all: none within the median
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(e)], "id long, e array<double>")
    train, test, n = sides(splits.neighbor_coverage_split(df))
    assert n == 4500 and len(train) == int(4500 * 0.7) and set(range(4490, 4500)) <= train


def test_coverage_by_brute_force(spark):
    rng = np.random.RandomState(5)
    x = np.concatenate([rng.randn(70, 2), rng.randn(20, 2) * 6])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, e array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    off = ~np.eye(90, dtype=bool)
    near, train = (d <= np.median(d[off])) & off, start_of(range(90))
    for j in np.flatnonzero(~train):
        if near[j, train].sum() < 25:
            rows = np.flatnonzero(train)
            redundant = near[np.ix_(rows, rows)].sum(1)
            if redundant.max() > 25:
                train[rows[redundant.argmax()]], train[j] = False, True
    assert (train != start_of(range(90))).any()
    found = kernels.swap_covered(df, None, "euclidean", 0.7, 42, 25, kernels.neighbor_coverage(25), block_rows=40)
    assert sides(found)[0] == set(np.flatnonzero(train))
    near, train = (d <= 0.8) & off, start_of(range(90))
    covered = lambda t: near[np.ix_(~t, t)].any(1).sum()
    better = True
    while better:
        better, now = False, covered(train)
        for j in np.flatnonzero(~train & ~near[:, train].any(1)):
            tries = []
            for r in np.flatnonzero(train):
                t = train.copy()
                t[r], t[j] = False, True
                tries.append((-covered(t), r))
            if -min(tries)[0] > now:
                train[min(tries)[1]], train[j], better = False, True, True
                break
    assert (train != start_of(range(90))).any()
    found = kernels.swap_covered(df, 0.8, "euclidean", 0.7, 42, 1, kernels.max_coverage, block_rows=40)
    assert sides(found)[0] == set(np.flatnonzero(train))
