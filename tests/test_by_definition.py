"""Operators that SQL can't express, held against small implementations written from their definitions alone."""

import difflib
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleaveset.functions import text as fn
from cleaveset.operators import audio, cluster, embedding, graph, image, kernels, splits
from cleaveset.sources import generators


def points(seed, n, d):
    rng = np.random.RandomState(seed)
    return np.concatenate([rng.randn(n // 2, d), rng.randn(n - n // 2, d) * 2 + 3])


def gap_of_centroids(x, t):
    return np.sqrt(sum((a - b) ** 2 for a, b in zip(x[t].mean(0), x[~t].mean(0))))


def gap_of_moments(x, t):
    return np.linalg.norm(x[t].mean(0) - x[~t].mean(0)) + np.linalg.norm(x[t].var(0) - x[~t].var(0))


def kolmogorov(x, t):
    out = []
    for j in range(x.shape[1]):
        at = np.unique(x[:, j])
        out.append(max(abs((x[t, j] <= v).mean() - (x[~t, j] <= v).mean()) for v in at))
    return float(np.mean(out))


def gap_of_histograms(x, t):
    total = 0.0
    for j in range(x.shape[1]):
        edges = np.percentile(x[:, j], np.linspace(0, 100, 11))
        a, b = (np.histogram(x[m, j], edges, density=True)[0] for m in (t, ~t))
        total += np.abs(a - b).sum()
    return total


def discrepancy(x, t):
    k = np.exp(-np.array([[((a - b) ** 2).sum() for b in x] for a in x]) / x.shape[1])
    return k[np.ix_(t, t)].mean() + k[np.ix_(~t, ~t)].mean() - 2 * k[np.ix_(t, ~t)].mean()


CLIMBS = [(kernels.Centroids, gap_of_centroids), (kernels.Moments, gap_of_moments), (kernels.Distribution, kolmogorov), (kernels.Histograms, gap_of_histograms), (kernels.Discrepancy, discrepancy)]


@pytest.mark.parametrize("kernel,objective", CLIMBS)
@pytest.mark.parametrize("seed", [1, 2])
def test_hill_climbs_take_the_swaps_of_their_definition(kernel, objective, seed):
    x = points(seed, 40, 2)
    start = np.arange(40) % 10 < 7
    got = kernel(120)(x, start.copy(), np.random.RandomState(seed), np.arange(40))
    rng, t = np.random.RandomState(seed), start.copy()
    tr, te = list(np.flatnonzero(t)), list(np.flatnonzero(~t))
    best = objective(x, t)
    for _ in range(120):
        a, b = rng.randint(len(tr)), rng.randint(len(te))
        trial = t.copy()
        trial[tr[a]], trial[te[b]] = False, True
        now = objective(x, trial)
        if now < best - 1e-12:
            best, t = now, trial
            tr[a], te[b] = te[b], tr[a]
    assert (got == t).all() and objective(x, got) < objective(x, start)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<double>")


def seeded(n, seed=42):
    import hashlib

    return sorted(range(n), key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest())


@pytest.mark.parametrize("pin", [False, True])
def test_nearest_neighbour_split_is_the_scan(spark, pin):
    x = points(5, 60, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    train, pinned, need = set(range(60)), set(), 60 - int(60 * 0.7)
    for i in seeded(60):
        if need and int(d[i].argmin()) in train and i not in pinned:
            train.discard(i)
            if pin:
                pinned.add(int(d[i].argmin()))
            need -= 1
    for i in seeded(60):
        if need and i in train and i not in pinned:
            train.discard(i)
            need -= 1
    got = {r.id for r in splits.nearest_neighbor_split(frame(spark, x), pin=pin).where("split = 'train'").collect()}
    assert got == train


def test_kmeans_is_a_fixed_point_and_its_splits_follow_from_it(spark):
    x = points(6, 90, 2)
    df = frame(spark, x)
    named, centers = cluster.kmeans(df, 5)
    label = {r.id: r.cluster for r in named.collect()}
    center = {r.cluster: np.array(r.center) for r in centers.collect()}
    for k, c in center.items():
        own = x[[i for i in label if label[i] == k]]
        assert np.allclose(c, own.mean(0), atol=1e-2)
    for i, k in label.items():
        assert ((x[i] - center[k]) ** 2).sum() <= min(((x[i] - c) ** 2).sum() for c in center.values()) + 1e-9
    assert sorted(center) == sorted({k: min(i for i in label if label[i] == k) for k in center}, key=lambda k: min(i for i in label if label[i] == k))
    sizes = {k: sum(v == k for v in label.values()) for k in center}

    def fold(order):
        left, train = int(90 * 0.7), set()
        for k in order:
            if sizes[k] <= left:
                train.add(k)
                left -= sizes[k]
        return {i for i in label if label[i] in train}

    side = lambda d: {r.id for r in d.where("split = 'train'").collect()}
    assert side(splits.cluster_split(df, n_clusters=5)) == fold(sorted(center, key=lambda k: (-sizes[k], k)))
    far = {k: round(float(np.linalg.norm(c - x.mean(0))), 6) for k, c in center.items()}
    assert side(splits.centroid_adversarial_split(df, n_clusters=5)) == fold(sorted(center, key=lambda k: (far[k], k)))
    leak = side(splits.cluster_leak_split(df, n_clusters=5))
    for k in center:
        own = [i for i in seeded(90) if label[i] == k]
        assert leak & set(own) == set(own[: int(len(own) * 0.7)])


def test_isolation_forest_scores_by_walking_the_trees(spark):
    x = np.concatenate([points(7, 120, 2), [[30.0, -30.0]]])
    rng = np.random.RandomState(1)
    forest = [embedding._grow(x[rng.permutation(len(x))[:64]], 0, 6, rng) for _ in range(20)]

    def walk(tree, row, depth=0):
        if len(tree) == 1:
            n = tree[0]
            return depth + (0 if n <= 1 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)
        return walk(tree[2] if row[tree[0]] < tree[1] else tree[3], row, depth + 1)

    for tree in forest:
        assert np.allclose(embedding._paths(tree, x), [walk(tree, r) for r in x])
    scores = {r.id: r.score for r in embedding.isolation_forest(frame(spark, x)).collect()}
    assert max(scores, key=scores.get) == 120 and all(0 < s < 1 for s in scores.values())
    train = {r.id for r in splits.outlier_adversarial_split(frame(spark, x)).where("split = 'train'").collect()}
    assert train == set(sorted(scores, key=lambda i: (scores[i], i))[: int(121 * 0.7)])


@pytest.mark.parametrize("seed", range(6))
def test_minimum_cut_is_the_least_of_all_cuts(seed):
    rng = np.random.RandomState(seed)
    w = np.triu(rng.rand(8, 8) * (rng.rand(8, 8) < 0.7), 1)
    w[np.arange(7), np.arange(1, 8)] += 0.05  # connected
    w = w + w.T
    cost = lambda side: w[np.ix_(sorted(side), sorted(set(range(8)) - set(side)))].sum()
    least = min(cost(c) for k in range(1, 5) for c in itertools.combinations(range(8), k))
    assert cost(graph.stoer_wagner(w)) == pytest.approx(least)


def test_spectral_splits_follow_the_second_eigenvector(spark):
    x = points(8, 40, 2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sigma = np.median(d[d > 0])
    w = np.exp(-(d**2) / (2 * sigma * sigma))
    np.fill_diagonal(w, 0)
    for split, weights, guard in ((splits.min_cut_split, np.where(w >= np.median(w[w > 0]), w, 0), 0.0), (splits.normalized_cut_split, w, 1e-10)):
        inv = np.diag(1 / np.sqrt(weights.sum(1) + guard))
        lap = np.eye(40) - inv @ weights @ inv
        scores = {r.id: r.score for r in split(frame(spark, x)).collect()}
        v = np.array([scores[i] for i in range(40)])
        assert np.allclose(lap @ v, np.sort(np.linalg.eigvalsh(lap))[1] * v, atol=1e-6) and np.linalg.norm(v) == pytest.approx(1, abs=1e-6)
        train = {r.id for r in split(frame(spark, x)).where("split = 'train'").collect()}
        assert train == set(sorted(range(40), key=lambda i: (v[i], i))[:28])


def test_sequence_matcher(spark):
    rows = [("abcd efg", "abcx efg"), ("", ""), ("a b c d", "d c b a"), ("x" * 300, "x" * 150 + "y" * 150), (None, "a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, x string, y string")
    got = df.select("id", fn.difflib_character_similarity("x", "y").alias("c"), fn.difflib_token_similarity(F.col("x"), F.col("y")).alias("t")).collect()
    for r in got:
        x, y = rows[r.id]
        if x is None:
            assert r.c is None and r.t is None
        else:
            assert r.c == difflib.SequenceMatcher(None, x, y).ratio() and r.t == difflib.SequenceMatcher(None, x.split(), y.split()).ratio()


def test_sentences(spark):
    texts = ["One. Two! Three?", "No end", "", "First line.\n\nSecond one here. Third."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    from cleaveset.operators import text

    assert [r.score for r in sorted(text.sentence_count(df).collect(), key=lambda r: r.id)] == [3, 1, 0, 3]


def spectrum(y):
    """Magnitudes by the transform's own sum, frame by frame."""
    y = np.concatenate([np.zeros(1024), y, np.zeros(1024)])
    n = np.arange(2048)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / 2048)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(1025), n) / 2048)
    return np.stack([np.abs(basis @ (y[s : s + 2048] * window)) for s in range(0, len(y) - 2047, 512)], 1)


def mel(f):
    return f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) * 27 / math.log(6.4)


def hertz(m):
    return m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)


def decibels(s, sr):
    edge = [hertz(mel(sr / 2) * i / 129) for i in range(130)]
    f = np.arange(1025) * sr / 2048
    bank = np.array([[max(0.0, min((v - a) / (b - a), (c - v) / (c - b))) * 2 / (c - a) for v in f] for a, b, c in zip(edge, edge[1:], edge[2:])])
    db = 10 * np.log10(np.maximum(bank @ s**2, 1e-10))
    return np.maximum(db, db.max() - 80)


@pytest.mark.parametrize("name", ["harmonic", "noisy", "fast"])
def test_audio_features_by_their_sums(name):
    y, sr = generators.named_sounds()[name][:6000], 22050
    s = spectrum(y)
    f = np.arange(1025)[:, None] * sr / 2048
    total = np.maximum(s.sum(0), 1e-300)
    centre = (f * s).sum(0) / total
    assert audio.spectral_centroid(y, sr) == pytest.approx(centre.mean(), rel=1e-6)
    assert audio.spectral_bandwidth(y, sr) == pytest.approx(np.sqrt((s * (f - centre) ** 2).sum(0) / total).mean(), rel=1e-6)
    db = decibels(s, sr)
    dct = np.array([[(math.sqrt(1 / 128) if k == 0 else math.sqrt(2 / 128)) * math.cos(math.pi * k * (2 * i + 1) / 256) for i in range(128)] for k in range(13)])
    c = dct @ db
    assert audio.mfcc_mean(y, sr) == pytest.approx(c[0].mean(), rel=1e-6) and audio.mfcc_variance(y, sr) == pytest.approx(((c - c.mean(1, keepdims=True)) ** 2).mean(1).mean(), rel=1e-6)
    onset = [0.0] + [np.mean([max(0.0, b - a) for a, b in zip(db[:, t - 1], db[:, t])]) for t in range(1, db.shape[1])]
    assert audio.beat_strength(y, sr) == pytest.approx(np.mean(onset), rel=1e-6)
    assert audio.zlib_ratio(y, sr) == len(y) * 4 / len(zlib.compress((np.clip(y, -1, 1) * 32767).astype(np.int16).tobytes(), 6))


def test_tempo_of_clicks_and_pitch_of_tones():
    sr = 22050
    for every in (0.4, 0.5, 0.6):
        y = np.zeros(6 * sr)
        for k in range(int(6 / every)):
            y[int(k * every * sr) :][:200] += np.exp(-np.arange(200) / 40)
        assert audio.tempo(y, sr) == pytest.approx(60 / every, rel=0.05)
    for f in (110.0, 440.0, 880.0):
        assert audio.fundamental_frequency(np.sin(2 * np.pi * f * np.arange(sr) / sr), sr) == pytest.approx(f, rel=0.01)


def test_dominant_colour_of_few_colours_is_the_commonest():
    rng = np.random.RandomState(9)
    colours = np.array([[10, 20, 30], [200, 10, 10], [0, 250, 0], [90, 90, 200]], np.uint8)
    for seed in range(5):
        pick = rng.choice(4, (20, 30), p=[0.1, 0.2, 0.2, 0.5])
        a = colours[pick]
        want = colours[np.bincount(pick.ravel()).argmax()][::-1]  # pixels are B, G, R
        assert (image.dominant_rgb(a, 5, seed, 10_000) == want).all()


def test_frequency_share_by_the_transform_of_its_sum():
    rng = np.random.RandomState(10)
    a = rng.randint(0, 256, (16, 12, 3)).astype(np.uint8)
    g = np.array([[(int(p[2]) * 299 + int(p[1]) * 587 + int(p[0]) * 114) // 1000 for p in row] for row in a], float)
    low = high = 0.0
    for u in range(16):
        for v in range(12):
            m = abs(sum(g[y, x] * np.exp(-2j * np.pi * (u * y / 16 + v * x / 12)) for y in range(16) for x in range(12)))
            du, dv = (u + 8) % 16 - 8, (v + 6) % 12 - 6
            if math.hypot(du, dv) <= 12 // 8:
                low += m
            else:
                high += m
    assert image.frequency_share(a) == pytest.approx(high / (low + high))
    assert image.frequency_share(np.zeros((8, 8, 3), np.uint8)) == 0.0
