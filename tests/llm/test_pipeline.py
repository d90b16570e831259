import hashlib
import re
from collections import Counter

import corpus_pipeline
from cleaveset.llm import langid

from ._cases import awkward, empty
from .test_mix_shard_secrets import fill, shard_of
from .test_pairs_and_search import brute, lcs


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def holds(item, text):
    """Whether a stretch of the text has three quarters of the item's words in order: the plain part of the leak rule."""
    w = [x.lower() for x in words(text)]
    step = max(1, len(item) // 2)
    return any(lcs(item, w[a : a + 3 * len(item)]) >= 0.75 * len(item) for a in range(0, max(1, len(w)), step) if len(set(item) & set(w[a : a + 3 * len(item)])) >= 0.6 * len(set(item)))


def mixed(rows, seed=42):
    """How often each row is in the mix, by pouring words into sources and walking each hash order."""
    size = {i: len(words(t)) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)}
    target = fill({s: 2.0 * n for s, n in total.items()}, weights, 1.5 * sum(total.values()))
    out = {}
    for s in sources:
        budget = round(target[s])
        turns, left = divmod(budget, total[s]) if total[s] else (0, 0)
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i)):
            more = 1 if left >= size[i] or 2 * left > size[i] else 0
            left = left - size[i] if left >= size[i] else -1
            if size[i]:
                out[i] = int(turns + more)
    return {i: n for i, n in out.items() if n}


def test_stages_and_run(spark, sf_dir):
    """Each stage against its own brute force on what the stages before it kept, and run() against all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [[x.lower() for x in words(r.text)] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    known = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    letters = {i for i, r in rows.items() if langid.has_letter(r.text)}
    assert known <= letters and len(letters - known) <= 0.02 * len(letters)
    part = docs.where(docs.doc_id.isin(list(known)))
    alone = {d for d, _, _, c in brute([(i, rows[i].text) for i in sorted(known)]) if d == c}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, part, sf_dir).collect()} == alone
    part = docs.where(docs.doc_id.isin(list(alone)))
    clean = {r.doc_id for r in corpus_pipeline.drop_benchmark_leaks(spark, part, sf_dir).collect()}
    leaky = {i for i in alone if any(holds(w, rows[i].text) for w in items)}
    assert clean <= alone - leaky and len(alone - leaky - clean) <= 0.02 * len(alone)  # paraphrases of less than three quarters
    part = docs.where(docs.doc_id.isin(list(clean)))
    want = mixed([(i, rows[i].text, rows[i].source) for i in sorted(clean)])
    assert Counter(r.doc_id for r in corpus_pipeline.mix(spark, part, sf_dir).collect()) == want
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in found) == want
    slots = {}
    for r in found:
        assert r.shard == shard_of(r.doc_id, [1.0] * 40) and r.size == len(rows[r.doc_id].text.encode()) + 16
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_take_awkward_tables(spark, sf_dir):
    docs = awkward(spark)
    left = {"language_id": 8, "near_duplicates": 10, "decontamination": 13, "mixing": None, "sharding": 13}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        if name != "sharding":
            assert found.columns == docs.columns, name
        n = len(found.collect())
        assert left[name] in (None, n), (name, n)
        assert stage(spark, empty(spark), sf_dir).collect() == [], name


def test_run_of_an_empty_corpus(spark, tmp_path):
    for name, df in (("documents", empty(spark)), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.drop("a.b").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
