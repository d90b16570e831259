import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cleaveset.llm import decontaminate, neighbours, ngram_join
from cleaveset.llm._graph import components
from cleaveset.llm._store import Store

from ._cases import awkward, empty


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s = [grams(t) for _, t in rows]
    link = [[j for j in range(len(rows)) if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])] for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(s[i]), len(link[i]), min(ids) if ids else None))
    return out


def as_rows(df):
    return [(r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in df.collect()]


key = lambda r: tuple((x is None, x or 0) for x in r)


def family(seed, n):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        if i % 5 == 4:
            base = w
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("options", [{}, {"range_bytes": 4000, "chunk_bytes": 20000, "broadcast_bytes": 0, "on_driver": 0}, {"range_bytes": 300, "chunk_bytes": 3000, "held_shingles": 500, "fan": 8}, {"bits": 3}])
def test_jaccard_matches_brute_force(spark, options):
    texts = family(1, 40) + family(2, 25) + [f"only {i} here with its own few words {i * i}" for i in range(20)] + ["short one", "Short  ONE", "", None]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (None, texts[1]), (None, "nothing like it at all in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(as_rows(ngram_join.jaccard_join(df, **options)), key=key) == sorted(brute(rows), key=key)
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect()]
    want = {(d, c) for d, n, _, c in brute(rows) if n}
    components_kept = [next(c for d, n, _, c in brute(rows) if d == i) for i, t in kept if grams(t) and i is not None]
    assert len(components_kept) == len(set(components_kept)) == len({c for _, c in want if c is not None})


def test_jaccard_awkward(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(as_rows(ngram_join.jaccard_join(docs)), key=key) == sorted(brute(rows), key=key)
    assert ngram_join.jaccard_join(empty(spark)).collect() == []
    assert ngram_join.one_of_each(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=14), st.integers(0, 3))
def test_prefix_tree_finds_all(sets, split):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    stored, asked = arrays, arrays[split:] or arrays
    a, b = ngram_join.linked(stored, asked)
    want = {(i, j) for i, x in enumerate(asked) for j, y in enumerate(stored) if 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_components(spark, limit):
    rng = np.random.RandomState(4)
    e = rng.randint(0, 60, (50, 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in e], "a long, b long")
    got = {r.node: r.component for r in components(df, Store(spark), "t", limit).collect()}
    label = {i: i for i in range(60)}
    for _ in range(60):
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    touched = {int(x) for a, b in e if a != b for x in (a, b)}
    assert got == {i: label[i] for i in touched}


def test_neighbours_match_brute_force(spark):
    rng = np.random.RandomState(5)
    x = rng.randn(600, 8).astype(np.float32)
    x[100:140] = x[50]  # copies: ties go to the smaller id
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows[7], rows[8], rows[9] = (7, None), (8, [0.0] * 8), (9, [float("nan")] + [1.0] * 7)
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (50, rows[50][1]), (1002, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for options in ({}, {"shard_rows": 90, "query_block": 5}):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(df, **options).collect()}
        live = [(i, np.array(v, float)) for i, v in rows[:600] if v and np.isfinite(v).all() and any(v)]
        for q in range(0, 600, 50):
            a = dict(live)[q]
            want = sorted((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i) for i, b in live if i != q)[:5]
            assert [got[q, k][0] for k in range(1, 6)] == [i for _, i in sorted((round(s, 12), i) for s, i in want)]
        assert got[1000, 1][0] == 1001 and (1000, 2) not in got
    found = neighbours.nearest(df, factor=1.5).collect()
    exact = {(q, v) for (q, _), (v, _) in got.items()}
    assert len({(r.query_id, r.vec_id) for r in found} & exact) / len(exact) >= 0.9
    with pytest.raises(ValueError):
        neighbours.nearest(df, factor=0.5)
    assert neighbours.nearest(df.limit(0)).collect() == []


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20), st.lists(st.integers(0, 7), max_size=30))
def test_bitwise_subsequence(a, b):
    assert decontaminate.common(*decontaminate.Index.bits(a), b) == lcs(a, b)


def test_sketch_and_eigenvectors():
    rng = np.random.RandomState(6)
    a = rng.rand(300, 40) @ np.diag(np.linspace(3, 0.01, 40))
    a[a < 0.6] = 0
    p, t = np.nonzero(a)
    omega = np.linalg.qr(rng.randn(40, 20))[0]
    y = np.zeros((40, 20))
    dense = np.arange(5)
    rank = np.full(40, -1)
    rank[dense] = dense
    decontaminate.multiply(p, t, a[p, t], 300, dense, rank, omega.astype(np.float32), y)
    assert np.allclose(y, a.T @ (a @ omega), rtol=1e-4, atol=1e-3)
    v = decontaminate.eigenvectors(a.T @ (a @ omega), omega, 3)
    u = np.linalg.svd(a)[2][:3].T
    assert np.abs(np.abs((u * v).sum(0))[0] - 1) < 0.02


def test_leaks_match_brute_force(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: r.text.lower().split() for r in bench.collect()}
    rng = random.Random(0)
    planted = []
    for k, (i, w) in enumerate(sorted(items.items())[:12]):
        noise = [f"filler{rng.randrange(99)}" for _ in range(150)]
        changed = [x if rng.random() > 0.12 else f"swap{rng.randrange(50)}" for x in w]
        planted.append((10**6 + k, " ".join(noise[:70] + (w if k % 2 else changed) + noise[70:]), i))
    extra = spark.createDataFrame([(d, t) for d, t, _ in planted], "doc_id long, text string")
    rows = decontaminate.find_leaks(docs.select("doc_id", "text").union(extra), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert {(d, i) for d, _, i in planted} <= got
    for r in docs.collect():
        text = " " + " ".join(r.text.lower().split()) + " "
        for i, w in items.items():
            if " " + " ".join(w) + " " in text:
                assert (r.doc_id, i) in got
    clean = [x for x in got if x[0] < 10**6]
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    for d, i in clean:
        assert lcs(items[i], texts[d]) >= 0.6 * len(items[i])
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in clean}


def rewritten(words, rng, kind):
    """A paraphrase of an item: words swapped for others, put in, left out, or its parts in another order."""
    w = list(words)
    if kind == "swap":
        return [x if rng.random() > 0.2 else f"other{rng.randrange(40)}" for x in w]
    if kind == "insert":
        return [y for x in w for y in ([x, f"more{rng.randrange(40)}"] if rng.random() < 0.25 else [x])]
    if kind == "drop":
        return [x for x in w if rng.random() > 0.15]
    for _ in range(max(1, len(w) // 12)):
        i = rng.randrange(len(w) - 1)
        w[i], w[i + 1] = w[i + 1], w[i]
    return w


def test_leaks_follow_the_documented_rule(spark, sf_dir):
    """Every window of every text against every item, without candidate search: the same pairs and measures."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(15)
    items = {r.item_id: r.text for r in bench.collect()}
    rng = random.Random(4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    kinds = ["swap", "insert", "drop", "move"]
    planted = []
    for k in range(40):
        i = sorted(items)[k % len(items)]
        noise = [f"noise{rng.randrange(99)}" for _ in range(rng.randrange(60, 160))]
        at = rng.randrange(len(noise))
        docs.append((10**6 + k, " ".join(noise[:at] + rewritten(items[i].split(), rng, kinds[k % 4]) + noise[at:])))
        planted.append((10**6 + k, i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.lcs, r.answer, r.cosine) for r in decontaminate.find_leaks(df, bench).collect()}
    (shared,) = next(decontaminate.passes(df, bench, "text", "item_id", "text"))
    index = shared.value
    terms = decontaminate.Terms.__new__(decontaminate.Terms)
    terms.hashes = index.hashes
    want = {}
    for d, t in docs:
        h = next(iter(decontaminate.batches(__import__("pyarrow").array([t]))))[2]
        term = terms.ids(h).tolist()
        for start in range(0, len(term), decontaminate.BLOCK):
            stop = min(len(term), start + decontaminate.BLOCK * decontaminate.SPAN)
            v = sum((index.project[x].astype(float) for x in term[start:stop] if x >= 0), np.zeros(index.project.shape[1]))
            for q, k in enumerate(index.owner):
                own = index.items[k]
                cosine = float(v @ index.queries[q] / max(np.linalg.norm(v), 1e-30))
                if cosine < index.cosine:
                    continue
                span = term[max(0, start - len(own)) : stop + len(own)]
                share, answer = lcs(own, span) / len(own), lcs(own[-8:], span) / min(8, len(own))
                if share >= 0.75 or share >= 0.6 and answer >= 0.6 and cosine >= 0.4:
                    key = d, index.ids[k]
                    want[key] = max(want.get(key, (0, 0, 0)), (share, answer, cosine))
    assert set(found) == set(want)
    for key in want:
        assert found[key] == pytest.approx(want[key], abs=1e-4)
    hit = sum(p in found for p in planted)
    assert hit >= 0.95 * len(planted), hit
    print("paraphrases found", hit, "of", len(planted))


def test_leaks_awkward(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, None), (3, "Kurzer SATZ"), (4, "12345"), (5, ""), (None, "fox jumps over the lazy dog and runs far"), (1, "The quick brown fox jumps over the lazy dog")], "item_id long, text string")
    docs = awkward(spark)
    for size in (decontaminate.ITEMS, 1):  # one round, and one for each item
        monkeypatch.setattr(decontaminate, "ITEMS", size)
        monkeypatch.setattr(decontaminate, "PASS", size if size == 1 else 4)
        rows = decontaminate.find_leaks(docs, bench).collect()
        assert sorted((r.doc_id, r.item_id or 0) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 0), (2, 1), (2, 1), (7, 0), (7, 1), (8, 4), (9, 3)]
        assert {r.verdict for r in rows} == {"verbatim"}
        kept = decontaminate.without_leaks(docs, bench)
        assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 6, 10]
    assert decontaminate.find_leaks(empty(spark), bench).collect() == []
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == [] and decontaminate.without_leaks(docs, bench.limit(0)).count() == 13


def test_leaks_in_later_batches(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog")], "item_id long, text string")
    rows = [(i, "nothing of the kind is in this text" if i < 5 else "see the quick brown fox jumps over the lazy dog") for i in range(8)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), bench).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.doc_id for r in found) == [5, 6, 7]


def test_a_map_task_of_the_join_holds_little():
    """Peak of a task that hashes and packs 3 million different shingles, and the largest batch that it returns."""

    class Texts:
        def mapInArrow(self, run, schema):
            return run

    def column(k):
        numbers = np.random.RandomState(k).randint(0, 1 << 40, (300, 1000))
        return pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, x)) for x in numbers])], ["text"])

    columns = [column(k) for k in range(10)]
    run = ngram_join._pack(Texts(), ngram_join.Ranges(100), ngram_join.WORDS, ngram_join.Names(), ngram_join.HELD)
    tracemalloc.start()
    try:
        sent = [(b.num_rows, b.nbytes, sum(len(x.as_py()) for x in b.column(1))) for b in run(iter(columns))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print("peak MB", peak / 1e6, "largest batch MB", max(n for _, n, _ in sent) / 1e6)
    assert sum(n for *_, n in sent) == 8 * 10 * 300 * 996
    assert peak < 120e6 and max(n for _, n, _ in sent) < 3e6


def test_terms_and_bounds_of_leaks(monkeypatch):
    """Terms by slots, several in one among them; a search verifies no window whose words can't hold enough of an item."""
    hashes = np.unique(np.concatenate([np.arange(9, dtype=np.uint64), np.random.RandomState(1).randint(0, 1 << 62, 500).astype(np.uint64) * np.uint64(4), np.array([(1 << 64) - 1], np.uint64)]))
    terms = decontaminate.Terms([hashes])
    asked = np.concatenate([hashes, hashes + np.uint64(1), np.arange(2000, dtype=np.uint64) << np.uint64(53)])
    where = {int(h): k for k, h in enumerate(hashes)}
    assert terms.ids(asked).tolist() == [where.get(int(h), -1) for h in asked]
    shift, _, crowded = terms.slots
    assert crowded[0] and crowded.sum() < 60

    words = [f"w{k}" for k in range(40)]
    item = next(decontaminate.batches(pa.array([" ".join(words)])))[2]
    terms = decontaminate.Terms([item])
    d = len(terms)
    index = decontaminate.Index([7], [item], terms, np.ones(d), np.eye(d), 0.25, 0.2, 0.4, 0.75, 0.6, 0.6, 8)
    calls = []
    verify = decontaminate.Index.verify
    monkeypatch.setattr(decontaminate.Index, "verify", lambda self, *x: calls.append(x) or verify(self, *x))
    search = lambda text: index.search(*next(decontaminate.batches(pa.array([text])))[2:])
    assert search(" ".join([*words[:20], *["other"] * 300])) == {} and not calls  # half of the item, 0.6 are needed
    assert search(" ".join(words[:30]))[0, 0][1] == 0.75 and calls
