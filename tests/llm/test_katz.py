import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cleaveset.llm import katz

from ._cases import awkward, empty

CUT = katz.CUT


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + ["</s>"]


def brute(rows, order=3):
    """Katz by recursion over plain dictionaries, with the mass of some histories for a check."""
    train = [words(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = Counter(w for t in train for w in t)
    n, v = sum(c1.values()), len(c1)
    coc = lambda c: [sum(1 for x in c.values() if x == r) for r in range(CUT + 2)]
    discounts = lambda c: katz.discounts(__import__("numpy").array(coc(c)))
    d1 = discounts(c1)
    kept = sum((1 - d1[r]) * r * coc(c1)[r] for r in range(1, CUT + 1))
    unk = kept / n if kept > 0 else 1 / (n + 1)
    p1 = lambda w: d1[min(c1[w], CUT + 1)] * c1[w] / (n if kept > 0 else n + 1) if c1[w] else unk
    grams = lambda t, k: [tuple((["<s>"] * (k - 1) + t)[i : i + k]) for i in range(len(t))]
    count = {k: Counter(g for t in train for g in grams(t, k)) for k in range(2, order + 1)}
    d = {k: discounts(count[k]) for k in count}
    hist, follow = defaultdict(int), defaultdict(list)
    for k in count:
        for g, x in count[k].items():
            hist[g[:-1]] += x
            follow[g[:-1]].append((g[-1], x))
    memo = {}

    def parts(h):
        if h not in memo:
            dk = d[len(h) + 1]
            seen = sum(dk[min(x, CUT + 1)] * x for _, x in follow[h]) / hist[h]
            full = 1 - seen < 1e-12
            left = 1 / (hist[h] + 1) if full else 1 - seen
            memo[h] = full, left / (1 - sum(p(h[1:], w) for w, _ in follow[h]))
        return memo[h]

    def p(h, w):
        if not h:
            return p1(w)
        if not hist[h]:
            return p(h[1:], w)
        full, alpha = parts(h)
        x = count[len(h) + 1][*h, w]
        return d[len(h) + 1][min(x, CUT + 1)] * x / (hist[h] + full) if x else alpha * p(h[1:], w)

    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, len(w), sum(c1[x] > 0 for x in w), n, base, sum(math.log10(p(g[:-1], g[-1])) for g in grams(w, order))))
    some = [("<s>",) * (order - 1), *[h for h in list(hist) if len(h) == order - 1][:4]]
    check = {h: sum(p(h, b) for b in c1) + p(h, None) for h in some}
    return out, check


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[4])


def values(df):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)


@pytest.mark.parametrize("chunk,entries,order", [(1_500_000, 400_000, 3), (3000, 1500, 3), (3000, 1500, 2), (2000, 3000, 4)])
def test_katz_matches_brute_force(spark, sf_dir, chunk, entries, order):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 80")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, mass = brute(rows, order)
    assert all(abs(x - 1) < 1e-9 for x in mass.values()), mass
    same(values(katz.score_texts(docs, order=order, chunk_tokens=chunk, range_entries=entries)), want)


def test_hot_histories_and_copies(spark):
    """A word that is a third of all tokens, texts many times over, and counts that nothing discounts."""
    rng = __import__("random").Random(3)
    rows = [(i, " ".join(rng.choice(["the", "the", f"w{rng.randrange(30)}", "of the"]) for _ in range(40))) for i in range(60)]
    rows += [(100 + i, "the same text again and again") for i in range(40)] + [(1, rows[1][1])] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, entries in ((1_500_000, 400_000), (400, 150)):
        same(values(katz.score_texts(df, chunk_tokens=chunk, range_entries=entries)), brute(rows)[0])


def test_katz_awkward(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    same(values(katz.score_texts(docs)), brute(rows)[0])
    assert katz.score_texts(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        katz.score_texts(docs, order=1)


def test_tasks_use_freed_memory_again():
    """Page faults of arrays of 10 MB that come and go: a few thousand for all of them, where each array has some."""
    import resource

    import numpy as np

    from cleaveset.llm._memory import keeping

    def faults():
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        for _ in range(100):
            np.ones(1_000_000, np.int8).repeat(10)
        return resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before

    with keeping():
        pass  # the session's thresholds
    plain = faults()
    with keeping():
        kept = faults()
    again = faults()
    print("page faults", plain, kept, again)
    assert kept < plain / 3 and again > plain / 2
