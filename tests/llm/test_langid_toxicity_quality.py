import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleaveset.llm import langid, quality, toxicity
from cleaveset.llm._sample import hash_sample
from cleaveset.llm._trees import Boosted, isotonic

from ._cases import awkward, empty, repeated


def held(i, m=5):
    return i is not None and zlib.crc32(str(i).encode()) % m == 0


def grams(t):
    t = "".join(c if c.isalpha() and ord(c) < 128 or ord(c) > 127 else " " for c in f" {t.lower()} ")
    while "  " in t:
        t = t.replace("  ", " ")
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_matches_sets():
    texts = ["Hello, world 123", "Grüße aus Köln!", "", "hello world"]
    row, place = langid.presence(texts)
    flags = [set(place[row == k].tolist()) for k in range(4)]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(len(flags[i] & flags[j]) - len(grams(a) & grams(b))) <= 1  # hashing may merge a pair of n-grams
    assert all((langid.unpack(langid.pack(np.array(sorted(f)))) == sorted(f)).all() for f in (flags[0], set(range(0, langid.BUCKETS, 3))))


def test_long_texts_do_not_fill_the_places():
    rng = np.random.RandomState(1)
    han = "".join(chr(c) for c in rng.randint(0x4E00, 0x9FFF, 60_000))
    latin = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 24_000))
    for text, share in ((han, 0.6), (latin, 0.1)):
        found, true = len(langid.presence([text])[1]), len(grams(text))
        assert found < share * langid.BUCKETS and found > (0.7 if text is han else 0.97) * true


def test_language_matches_brute_force(spark):
    """Exact n-gram sets, the same sample, and the ridge regression written out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(160).cache()
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    u = lambda i: int(__import__("hashlib").md5(f"{i}:fit".encode()).hexdigest()[:13], 16) / 2**52
    train = [r for r in rows if not held(r.doc_id) and r.lang is not None and langid.has_letter(r.text)]
    sample = [r for name in sorted({r.lang for r in train}) for r in sorted((r for r in train if r.lang == name), key=lambda r: u(r.doc_id))[:20]]
    mark = [k for k, r in enumerate(sample) if sum(x.lang == r.lang for x in sample[:k]) < 5]
    sets = [grams(r.text) for r in sample]
    kern = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kern(a, sets[m]) for m in mark] for a in sets])
    names = sorted({r.lang for r in sample})
    y = np.array([[float(r.lang == n) for n in names] for r in sample])
    w = np.array([1 / sum(x.lang == r.lang for x in sample) for r in sample])
    w *= len(sample) / w.sum()
    alpha = np.linalg.solve(k.T @ (w[:, None] * k) + langid.RIDGE * len(sample) * k[mark] + 1e-9 * np.eye(len(mark)), k.T @ (w[:, None] * y))
    found = {r.doc_id: r for r in langid.identify(docs, per_language=20, landmarks=5).collect()}
    for r in rows:
        value = np.array([kern(grams(r.text), sets[m]) for m in mark]) @ alpha if langid.has_letter(r.text) else None
        got = found[r.doc_id]
        if value is None:
            assert got.lang_pred == "und"
        else:
            assert abs(got.score - min(1, max(0, value.max()))) < 0.05
            if np.diff(np.sort(value))[-1] > 0.1:
                assert got.lang_pred == names[int(value.argmax())]


def test_repeated_ids_are_bounded(spark):
    docs = repeated(spark)
    own = docs.selectExpr("doc_id AS i", "lang", "text")
    sample = hash_sample(own, "lang", 3, 20, "text", F.md5("text")).collect()
    assert len(sample) == len({(r.lang, r.i, r.text) for r in sample}) and all(sum(r.lang == x for r in sample) <= 20 for x in ("en", "de", "fr"))
    assert len(langid.identify(docs).collect()) == docs.count()
    labels = spark.createDataFrame([(7, 1), (7, 0)] + [(100 + k, k % 2) for k in range(60)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, labels, per_label=20).collect()
    assert len(found) == docs.count() and len({r.score for r in found if r.doc_id == 7}) <= 101
    assert len(quality.classify_quality(docs, per_side=20).collect()) == docs.count()


def test_language_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.95
    assert langid.keep_identified(docs).columns == docs.columns


def test_language_awkward(spark):
    rows = {(r.doc_id): r for r in langid.identify(awkward(spark)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 8))
    assert rows[1].lang_pred == "en" and langid.identify(awkward(spark)).count() == 13
    assert langid.identify(empty(spark)).collect() == []
    kept = langid.keep_identified(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.where("doc_id IN (3, 4, 5, 8)").count() == 0


def test_trees_and_calibration():
    rng = np.random.RandomState(0)
    x = rng.rand(600, 3)
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    f = Boosted(trees=40).fit(x, y, np.ones(600)).predict(x)
    assert ((f > 0) == (y > 0)).mean() > 0.97
    xs, ys = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(ys) >= 0).all() and ys[1] == 0.5


def test_trees_match_brute_force():
    """The first split and the leaves of one tree, by trying every cut of every feature."""
    rng = np.random.RandomState(2)
    x, w = np.round(rng.rand(200, 3), 1), np.ones(200)
    y = (x[:, 1] > 0.45).astype(float)
    model = Boosted(trees=1, depth=1, least=5).fit(x, y, w)
    p = y.mean()
    g, h = p - y, np.full(200, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(x[:, j] < c), j, c) for j in range(3) for c in np.unique(x[:, j])[1:])
    left = x[:, best[1]] < best[2]
    want = np.where(left, *(-0.15 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left))) + np.log(p / (1 - p))
    assert np.allclose(model.predict(x), want, atol=1e-6)


def test_isotonic_matches_brute_force():
    """Minimax formula: the fit at i is the largest over starts of the least over ends of weighted means."""
    rng = np.random.RandomState(3)
    x, y, w = np.arange(30.0), (rng.rand(30) < np.linspace(0.1, 0.9, 30)).astype(float), rng.rand(30) + 0.5
    mean = lambda a, b: (w[a : b + 1] @ y[a : b + 1]) / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(np.interp(x, *isotonic(x, y, w)), want)
    odds = np.linspace(-8, 8, 400)
    knots = (np.array([-3.0, -1, 0, 2]), np.array([0.0, 0.0, 0.7, 1.0]))
    score, plain = toxicity.calibrated(odds, knots), np.clip(np.interp(odds, *knots), 0, 1)
    assert np.abs(score - plain).max() < 3e-6 and (np.diff(score) > 0).all() and ((score >= 0.5) == (plain >= 0.5)).all()


def test_features_match_brute_force():
    texts = ["You are an IDIOT!!! a total l0ser, you know", "nothing to see here 42", "", "x" * 5000 + " you fool", None, "¡tú estúpido!"]
    lexicon = {"loser": 2.0, "fool": 1.5, "tota-": 0.5}
    found = toxicity.features(__import__("pyarrow").array(texts, "string"), toxicity.Memo(lexicon))
    for t, row in zip(texts, found):
        raw = (t or "").lower().split()
        n = max(1, len(raw))
        letters = [toxicity.plain(x)[0] for x in raw]
        weight = [max([lexicon.get(x, 0)] + [lexicon.get(x[:k] + "-", 0) for k in (4, 5, 6) if len(x) >= k]) for x in letters]
        bad = [i for i, x in enumerate(letters) if weight[i] or x in toxicity.SEED]
        you = [i for i, x in enumerate(letters) if x in toxicity.YOU]
        near = sum(any(abs(i - j) <= 5 for j in you) for i in bad)
        hits = [v for v in weight if v]
        size = max(1, len((t or "").encode()))
        want = [np.log1p(len(raw)), len(hits), len(hits) / n, sum(hits), max(hits, default=0), len({x for x, v in zip(raw, weight) if v}), sum(x in toxicity.SEED for x in letters)]
        want += [want[6] / n, near, len(you) / n, sum("A" <= c <= "Z" for c in t or "") / size]
        want += [sum(33 <= ord(c) < 127 and not c.isalnum() and c not in "!?" for c in t or "") / size, sum(c in "!?" for c in t or "") / size]
        want += [sum(toxicity.plain(x)[1] for x in raw) / n, sum(c in "0123456789" for c in t or "") / size]
        assert np.allclose(row, want), (t, row, want)


def test_toxicity_of_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    pairs = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if held(r.doc_id)]
    good, bad = [s for s, t in pairs if not t], [s for s, t in pairs if t]
    assert np.mean([b > g for b in bad for g in good]) > 0.9
    assert np.mean([s >= 0.5 for s in good]) < 0.05 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (7, 1), (9, 1), (None, 1), (10, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(awkward(spark), labels).collect()
    assert len(found) == 13 and all(r.score is not None for r in found)
    assert toxicity.score_toxicity(empty(spark), labels).collect() == []
    none = toxicity.score_toxicity(awkward(spark), labels.where("toxic = 0")).collect()
    assert all(r.score == 0 for r in none)


def test_em_finds_accuracies():
    rng = np.random.RandomState(3)
    truth = rng.rand(20000) < 0.8
    accuracy = np.array([0.9, 0.8, 0.7, 0.85])
    v = np.where(rng.rand(20000, 4) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.rand(20000, 4) < 0.2] = -1
    patterns, at, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, found, prior = quality.expectation_maximisation(patterns, n.astype(float))
    assert abs(prior - 0.8) < 0.03 and np.abs(found[1] - accuracy).max() < 0.05
    assert ((post[at.ravel()] > 0.5) == truth).mean() > 0.9


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in quality.classify_quality(docs).collect()}
    labels = [(rows[r.doc_id].keep, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    assert np.mean([k for k, q in labels if q]) > 0.97 and np.mean([k for k, q in labels if not q]) < 0.2
    assert len(quality.classify_quality(awkward(spark)).collect()) == 13
    assert quality.classify_quality(empty(spark)).collect() == []
    for codes in (np.arange(3**9),):
        assert all(quality.code(tuple(p)) == c for c, p in zip(codes[::997], quality.decode(codes)[::997].tolist()))


def test_quality_matches_brute_force(spark):
    """EM over single votes and the scorer over feature sets, from the texts alone, in plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(90).cache()
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    vote = [quality.votes(r.text or "") for r in rows]
    acc, prior, post = [[0.8] * 9, [0.8] * 9], 0.7, [0.7] * len(rows)
    for _ in range(200):
        new = []
        for v in vote:
            good, bad = prior, 1 - prior
            for j, x in enumerate(v):
                good *= 1 if x < 0 else acc[1][j] if x else 1 - acc[1][j]
                bad *= 1 if x < 0 else 1 - acc[0][j] if x else acc[0][j]
            new.append(good / (good + bad))
        for side, target in ((0, 0), (1, 1)):
            weight = [p if side else 1 - p for p in new]
            acc[side] = [(sum(w for w, v in zip(weight, vote) if v[j] == target) + 8) / (sum(w for w, v in zip(weight, vote) if v[j] >= 0) + 10) for j in range(9)]
        prior = min(0.999, max(0.001, sum(new) / len(new)))
        moved, post = max(abs(a - b) for a, b in zip(new, post)), new
        if moved < 1e-9:
            break
    found = {r.doc_id: r for r in quality.classify_quality(docs, per_side=1000).collect()}
    assert all(abs(found[r.doc_id].posterior - p) < 1e-6 for r, p in zip(rows, post))
    u = lambda i: int(__import__("hashlib").md5(f"{i}:fit".encode()).hexdigest()[:13], 16) / 2**52
    places = {r.doc_id: quality.hashed(__import__("pyarrow").array([r.text or ""]))[1] for r in rows}
    sample = sorted(zip(rows, post), key=lambda x: (x[1] >= 0.5, u(x[0].doc_id)))
    w, bias = quality.train([(p, places[r.doc_id]) for r, p in sample])
    for r in rows:
        f = sum(w[p] for p in places[r.doc_id]) / max(1, len(places[r.doc_id])) ** 0.5 + bias
        assert found[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-f)), abs=1e-6)


def test_features_of_quality_are_packed_exactly():
    for p in ([], [0], [5, 6, 32767], list(range(0, 32768, 3))):
        assert quality.unpacked(quality.packed(np.array(p, np.int64))).tolist() == p


@pytest.mark.parametrize("text", ["", "one", "THE BIG!! SHOUT!! " * 30, "word " * 50, "A normal sentence of the usual kind, with words. And one more of them here. " * 4])
def test_votes_are_votes(text):
    assert len(quality.votes(text)) == len(quality.LABELLERS) and set(quality.votes(text)) <= {-1, 0, 1}
