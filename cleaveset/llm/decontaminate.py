"""Benchmark decontamination: latent semantic retrieval of passages, then longest common subsequence and answer checks.

The term space is the benchmark's vocabulary. Passages of all documents give the document frequencies and, in a second
pass, the sketch of a randomised SVD of the TF-IDF passage matrix; a third pass projects sliding windows and the items
into the latent space, takes cosine neighbours and verifies them word by word.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cleaveset.llm._rows import filter_rows
from cleaveset.llm._store import Store
from cleaveset.llm._words import batches, runs

BLOCK = 16  # words
SPAN = 4  # blocks of a window; passages of the SVD are half as long
FREQUENT = 64  # terms that are held dense
GROUP = 64  # passages, or twice as many blocks, whose terms are one dense product
#: Items and words of one round, and bytes of its table of words by item parts. More items take further rounds, of which
#: PASS are searched for in one pass over the documents, so what is held and broadcast at once stays bounded.
ITEMS, ITEM_WORDS, TABLE = 2000, 400_000, 64_000_000
PASS = 4
#: Items of fewer words are found as exact runs of words; too little is left of them for a latent space.
LEAST_WORDS = 5
#: A window that starts at each block holds at least this share of an item's part in it, so a leak has that share of
#: ``paraphrase`` of the part's words (as a multiset) in its best window; windows with fewer of them aren't compared word by word.
OVERLAP = 0.6


class Terms:
    """Sorted word hashes of the benchmark's vocabulary."""

    def __init__(self, items: list[np.ndarray]):
        self.hashes = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)

    @cached_property
    def slots(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """Slots by leading bits, some 16 a term: their shift, the first term from each on, and whether it has several."""
        bits = min(20, len(self.hashes).bit_length() + 4)
        shift = np.uint64(64 - bits)
        start = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << shift)
        return shift, np.minimum(start, len(self.hashes) - 1).astype(np.int32), np.diff(start, append=len(self.hashes)) > 1

    def __len__(self) -> int:
        return len(self.hashes)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 if it has none."""
        shift, first, crowded = self.slots
        slot = (h >> shift).astype(np.int64)
        at = first[slot]
        out = np.where(self.hashes[at] == h, at, -1).astype(np.int64)
        more = np.flatnonzero(crowded[slot])
        if len(more):
            at = np.minimum(np.searchsorted(self.hashes, h[more]), len(self.hashes) - 1)
            out[more] = np.where(self.hashes[at] == h[more], at, -1)
        return out


def blocks_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of each word, first block of each row and the end)."""
    n = np.diff(bounds)
    first = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
    within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
    return np.repeat(first[:-1], n) + within // BLOCK, first


def entries(term: np.ndarray, bounds: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, term, count) of the passages, which are runs of BLOCK * SPAN / 2 words of a row, and their number."""
    block, first = blocks_of(bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    half = SPAN // 2
    base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // half))])
    passage = base[:-1][row] + (block - first[:-1][row]) // half
    have = term >= 0
    key, count = np.unique(passage[have] * terms + term[have], return_counts=True)
    return key // terms, key % terms, count, int(base[-1])


def _frequencies(texts: DataFrame, vocabulary) -> tuple[np.ndarray, int]:
    """Passages with each term, and passages in all, over all documents."""

    def run(found):
        terms = Terms.__new__(Terms)
        terms.hashes = vocabulary.value
        df, n = np.zeros(len(terms), np.int64), 0
        for b in found:
            for _, _, h, bounds in batches(b.column(0)):
                _, t, _, m = entries(terms.ids(h), bounds, len(terms))
                df += np.bincount(t, minlength=len(terms))
                n += m
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1]])), pa.array(np.concatenate([df[at], [n]]))], ["term", "n"])

    out = np.zeros(len(vocabulary.value), np.int64)
    total = 0
    for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # one row a term
        if r["term"] < 0:
            total = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, total


def groups(place: np.ndarray, term: np.ndarray, weight: np.ndarray | None, n: int, size: int):
    """(first place, terms, places x terms) of each ``size`` places that have a term; ``place`` is sorted."""
    cut = np.searchsorted(place, np.arange(0, n + size, size))
    for k in np.flatnonzero(cut[1:] > cut[:-1]):
        own = slice(cut[k], cut[k + 1])
        local, at = np.unique(term[own], return_inverse=True)
        rows = min(size, n - k * size)
        key = (place[own] - k * size) * len(local) + at
        yield k * size, local, np.bincount(key, None if weight is None else weight[own], rows * len(local)).astype(np.float32).reshape(rows, -1)


def multiply(passage: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, dense: np.ndarray, rank: np.ndarray, omega: np.ndarray, y: np.ndarray) -> None:
    """y += A' A omega for the passages' sparse rows: products of frequent terms, and of the others of neighbouring passages."""
    often = rank[term] >= 0
    a = np.zeros((n, len(dense)), np.float32)
    a[passage[often], rank[term[often]]] = weight[often]  # a passage has a term once
    z = a @ omega[dense]
    others = passage[~often], term[~often], weight[~often]
    for k, local, part in groups(*others, n, GROUP):  # a passage is in one group
        z[k : k + GROUP] += part @ omega[local]
        y[local] += part.T @ z[k : k + GROUP]
    y[dense] += a.T @ z


def _sketch(texts: DataFrame, vocabulary, idf: np.ndarray, dense: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A' A omega over all passages, rows of A scaled to unit length: one partial sum a task, added by term ranges."""
    shared = texts.sparkSession.sparkContext.broadcast((idf, dense, omega))
    d, width = omega.shape
    step = 512

    def run(found):
        idf, dense, omega = shared.value
        terms = Terms.__new__(Terms)
        terms.hashes = vocabulary.value
        rank = np.full(d, -1)
        rank[dense] = np.arange(len(dense))
        y = np.zeros((d, width))
        for b in found:
            for _, _, h, bounds in batches(b.column(0)):
                p, t, c, n = entries(terms.ids(h), bounds, d)
                w = c * idf[t]
                norm = np.sqrt(np.bincount(p, w * w, n))
                multiply(p, t, w / norm[p], n, dense, rank, omega, y)
        at = list(range(0, d, step))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([y[a : a + step].astype(np.float32).tobytes() for a in at], pa.binary())], ["part", "sum"])

    def add(table: pa.Table) -> pa.Table:
        parts = sorted(x.as_py() for x in table["sum"])
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in parts)
        return pa.table([table["part"].slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())], ["part", "sum"])

    y = np.zeros((d, width))
    for r in texts.mapInArrow(run, "part int, sum binary").groupBy("part").applyInArrow(add, "part int, sum binary").collect():  # terms x width numbers
        y[r.part : r.part + step] = np.frombuffer(bytes(r.sum), np.float64).reshape(-1, width)
    return y


def eigenvectors(y: np.ndarray, omega: np.ndarray, k: int) -> np.ndarray:
    """Leading k eigenvectors of G from y = G omega (Nystroem): the right singular vectors of the passage matrix."""
    shift = 1e-7 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max() * 1e-10
    u, s, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u[:, :k]


def common(item: dict[int, int], full: int, span: list[int]) -> int:
    """Length of the longest common subsequence; item maps a term to the bits of its places."""
    v = full
    for t in span:
        m = item.get(t)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return (full & ~v).bit_count()


class Index:
    """What the search pass needs: items in the latent space, and their words for verification."""

    def __init__(self, ids: list, words: list[np.ndarray], terms: Terms, idf: np.ndarray, basis: np.ndarray, cosine: float, energy: float, alike: float, verbatim: float, paraphrase: float, answer: float, answer_words: int):
        self.ids, self.hashes = ids, terms.hashes
        self.short = self.terms = None
        self.weight = idf
        self.project = (basis * idf[:, None]).astype(np.float32)
        self.cosine, self.alike, self.verbatim, self.paraphrase, self.answer, self.answer_words = cosine, alike, verbatim, paraphrase, answer, answer_words
        self.items = [terms.ids(w).tolist() for w in words]
        self.counts = [np.unique(w, return_counts=True) for w in self.items]
        self.whole = [self.bits(w) for w in self.items]
        self.tails = [self.bits(w[-answer_words:]) for w in self.items]
        self.owner, rows, mass, enough = [], [], [], []
        member = []
        for k, w in enumerate(self.items):
            size = BLOCK * (SPAN - 1)
            parts = max(1, round(len(w) / size))
            for part in np.array_split(np.array(w, np.int64), parts):  # a long item asks by its parts
                v = np.bincount(part, minlength=len(idf))
                member.append(np.minimum(v, 255).astype(np.uint8))
                v = v * idf
                rows.append(v @ basis)
                mass.append((v * v).sum())
                self.owner.append(k)
                enough.append(OVERLAP * paraphrase * len(part))
        self.member, self.enough = np.array(member), np.array(enough)
        q = np.array(rows)
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)).astype(np.float32)
        self.least = energy * min(mass)
        self.owner = np.array(self.owner)

    @staticmethod
    def bits(words: list[int]) -> tuple[dict[int, int], int]:
        out: dict[int, int] = {}
        for i, t in enumerate(words):
            out[t] = out.get(t, 0) | 1 << i
        return out, (1 << len(words)) - 1

    def bound(self, k: int, span: np.ndarray) -> float:
        """Share of the item's words that the span has in any order, which is at least the share in order."""
        own, times = self.counts[k]
        at = np.minimum(np.searchsorted(own, span), len(own) - 1)
        return np.minimum(np.bincount(at[own[at] == span], minlength=len(own)), times).sum() / len(self.items[k])

    def verify(self, k: int, span: list[int], cosine: float) -> tuple[float, float] | None:
        """(share of the item in order within the span, same of its answer part) of a leak, else None."""
        share = common(*self.whole[k], span) / len(self.items[k])
        if share < self.paraphrase:
            return None
        answer = common(*self.tails[k], span) / min(len(self.items[k]), self.answer_words)
        return (share, answer) if share >= self.verbatim or answer >= self.answer and cosine >= self.alike else None

    def search(self, h: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) -> (cosine, share, answer share) of the leaks in the rows of a slice; of equal shares the largest cosine."""
        if self.terms is None:
            self.terms = Terms.__new__(Terms)
            self.terms.hashes = self.hashes
        term = self.terms.ids(h)
        if not len(term):
            return {}
        block, first = blocks_of(bounds)
        have = term >= 0
        total = np.concatenate([[0], np.cumsum(np.bincount(block[have], self.weight[term[have]] ** 2, first[-1]))])
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
        end = np.minimum(np.arange(first[-1]) + SPAN, first[1:][row])
        near = np.flatnonzero(total[end] - total[:-1] >= self.least)
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(near):
            return out
        latent = np.zeros((first[-1] + 1, self.project.shape[1]), np.float32)  # by block; windows are sums of blocks
        need = np.zeros(first[-1] + 1, bool)  # blocks of the windows that are compared
        for j in range(SPAN):
            need[np.minimum(near + j, end[near] - 1)] = True
        known = have & need[block]
        for a, local, counts in groups(block[known], term[known], None, int(first[-1]), 2 * GROUP):
            latent[a : a + len(counts)] = counts @ self.project[local]
        for a in range(0, len(near), 1024):
            window = near[a : a + 1024]
            r = row[window]
            start = bounds[r] + (window - first[r]) * BLOCK
            stop = np.minimum(bounds[r + 1], start + SPAN * BLOCK)
            size = stop - start
            at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            t = term[at]
            who = np.repeat(np.arange(len(window)), size)[t >= 0]
            t = t[t >= 0]
            v = latent[window]
            for j in range(1, SPAN):
                v += latent[np.where(window + j < end[window], window + j, first[-1])]  # the last row is zero
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
            score = v @ self.queries.T
            key, times = np.unique(who * len(self.hashes) + t, return_counts=True)
            which = key % len(self.hashes)
            who_at = np.searchsorted(key // len(self.hashes), np.arange(len(window) + 1))
            pair_w, pair_q = np.divmod(np.flatnonzero(score >= self.cosine), score.shape[1])
            count = who_at[pair_w + 1] - who_at[pair_w]
            pair_w, pair_q, count = pair_w[count > 0], pair_q[count > 0], count[count > 0]
            begin = np.cumsum(count) - count
            at = np.repeat(who_at[pair_w] - begin, count) + np.arange(count.sum())
            held = np.add.reduceat(np.minimum(self.member[np.repeat(pair_q, count), which[at]], times[at]), begin) if len(begin) else begin
            good = held >= self.enough[pair_q]
            for w, q in zip(pair_w[good], pair_q[good]):
                k = int(self.owner[q])
                key = (int(r[w]), k)
                if key in out and out[key][1] >= 1.0 and out[key][0] >= score[w, q]:
                    continue
                margin = len(self.items[k])
                span = term[max(bounds[r[w]], start[w] - margin) : min(bounds[r[w] + 1], stop[w] + margin)]
                if self.bound(k, span) < self.paraphrase:
                    continue
                found = self.verify(k, span.tolist(), float(score[w, q]))
                if found and (key not in out or (*found, float(score[w, q])) > (*out[key][1:], out[key][0])):
                    out[key] = (float(score[w, q]), *found)
        return out


class Short:
    """Items of one to LEAST_WORDS - 1 words, found as exact runs."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids = ids
        self.verbatim = 0.0
        self.tables = {}
        for n in sorted({len(w) for w in words}):
            own = [k for k, w in enumerate(words) if len(w) == n]
            key = np.array([runs(words[k], n)[0] for k in own], np.uint64)
            order = np.argsort(key, kind="stable")
            self.tables[n] = key[order], np.array(own)[order]

    def search(self, h: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        out = {}
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for n, (key, owner) in self.tables.items():
            found = runs(h, n)
            low, high = np.searchsorted(key, found), np.searchsorted(key, found, "right")
            for i in np.flatnonzero((low < high) & (row[: len(found)] == row[n - 1 :])):
                for k in owner[low[i] : high[i]]:
                    out[int(row[i]), int(k)] = (1.0, 1.0, 1.0)
        return out


def rounds_of(benchmark: DataFrame, item_col: str, item_text: str):
    """Lists of (item, word hashes) of bounded size, fetched piece by piece: long items in rounds, short ones in theirs."""
    asked = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    long: list = []
    short: list = []
    held, parts, seen = 0, 0, set()
    for row in asked.orderBy("item_id", "text").toLocalIterator():
        h = next(iter(batches(pa.array([row.text]))), (0, 0, np.zeros(0, np.uint64), None))[2]
        if not len(h):
            continue
        if len(h) < LEAST_WORDS:
            short.append((row.item_id, h))
            if len(short) == 50 * ITEMS:
                yield short
                short = []
            continue
        more = max(1, round(len(h) / (BLOCK * (SPAN - 1))))
        if long and (len(long) == ITEMS or held + len(h) > ITEM_WORDS or (parts + more) * len(seen | set(h.tolist())) > TABLE):
            yield long
            long, held, parts, seen = [], 0, 0, set()
        long.append((row.item_id, h))
        held, parts = held + len(h), parts + more
        seen.update(h.tolist())
    for rest in (long, short):
        if rest:
            yield rest


def passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, rank: int = 160, oversample: int = 16, cosine: float = 0.25, energy: float = 0.2, alike: float = 0.4, verbatim: float = 0.75, paraphrase: float = 0.6, answer: float = 0.6, answer_words: int = 8, seed: int = 3):
    """Lists of at most PASS broadcast indexes over the items."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    out = []
    for part in rounds_of(benchmark, item_col, item_text):
        ids, words = [i for i, _ in part], [h for _, h in part]
        if len(words[0]) < LEAST_WORDS:
            out.append(spark.sparkContext.broadcast(Short(ids, words)))  # at most 50 * ITEMS items of four words
        else:
            terms = Terms(words)
            d = len(terms)
            vocabulary = spark.sparkContext.broadcast(terms.hashes)
            df, n = _frequencies(texts, vocabulary)
            idf = np.log((n + 1.0) / (df + 1.0)) + 0.05
            width = min(d, rank + oversample)
            if width == d:
                basis = np.eye(d)  # the sketch would span every term: the space is the terms' own
            else:
                omega = np.linalg.qr(np.random.RandomState(seed).randn(d, width))[0].astype(np.float32)
                dense = np.sort(np.argsort(-df, kind="stable")[: min(FREQUENT, d)])
                y = _sketch(texts, vocabulary, idf, dense, omega)
                rows = np.array([np.bincount(terms.ids(w), minlength=d) * idf for w in words])
                rows /= np.linalg.norm(rows, axis=1, keepdims=True)
                weight = max(1.0, n / len(rows))  # the items weigh as much as the passages, so the space keeps them apart
                y += weight * (rows.T @ (rows @ omega))
                basis = eigenvectors(y, omega.astype(np.float64), rank)
            out.append(spark.sparkContext.broadcast(Index(ids, words, terms, idf, basis, cosine, energy, alike, verbatim, paraphrase, answer, answer_words)))  # bounded by TABLE and ITEM_WORDS
        if len(out) == PASS:
            yield out
            out = []
    if out:
        yield out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **parameters) -> DataFrame:
    """Pairs (doc_id, item_id) of whole texts that hold a benchmark item, verbatim or paraphrased.

    ``lcs`` is the share of the item's words found in order around the best window, ``answer`` the same of its last
    words; a pair is a leak if lcs is at least ``verbatim``, or at least ``paraphrase`` with ``answer`` of the answer
    and a cosine of at least ``alike``.

    Candidates are windows of SPAN blocks whose latent cosine with an item's part is at least ``cosine``, whose terms of
    the benchmark carry a share of ``energy`` of the least item's weight, and which hold at least OVERLAP *
    ``paraphrase`` of the part's words. Of the windows that show a leak, the one with the largest lcs, then answer, then
    cosine is reported. Items of fewer than LEAST_WORDS words are found as exact runs of words (cosine 1).

    * Null or empty texts hold nothing. Items that are null or without words aren't searched for, repeated ones once; an
      item with a null id gives pairs with a null item_id.
    * Repeated rows repeat their pairs; rows with a null id give pairs with a null id. Very long texts are searched whole,
      window by window. Ties between windows of equal measures give the same pair.
    * An empty table on either side gives an empty result; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, lcs double, answer double, verdict string"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    store = None
    out, waiting = None, None

    def searched(indexes: list) -> DataFrame:
        def run(found):
            for b in found:
                rows, items, values, verdict = [], [], [], []
                for shared in indexes:
                    index = shared.value
                    for a, _, h, bounds in batches(b.column(1)):
                        for (r, k), v in sorted(index.search(h, bounds).items()):
                            rows.append(a + r)
                            items.append(index.ids[k])
                            values.append(v)
                            verdict.append("verbatim" if v[1] >= 1.0 else "near" if v[1] >= index.verbatim else "paraphrase")
                cosine, share, answer = (pa.array([v[j] for v in values], pa.float64()) for j in range(3))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(items, item_type), cosine, share, answer, pa.array(verdict, pa.string())], ["doc_id", "item_id", "cosine", "lcs", "answer", "verdict"])

        return rows.mapInArrow(run, schema)

    for number, indexes in enumerate(passes(docs, benchmark, text_col, item_col, item_text, **parameters)):
        if waiting is not None:  # several passes: each is written, and its indexes are freed
            store = store or Store(docs.sparkSession)
            done = store.keep(searched(waiting), f"leaks-{number}")
            out = done if out is None else out.unionByName(done)
            for shared in waiting:
                shared.unpersist()
        waiting = indexes
    if waiting is None:
        return docs.sparkSession.createDataFrame([], schema)
    return searched(waiting) if out is None else out.unionByName(searched(waiting))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns.

    Rows are judged as in ``find_leaks``: null and empty texts stay, items with a null id count, repeated rows go or stay
    together, very long texts are searched whole; an empty table gives an empty one, an empty benchmark takes nothing.
    Columns are carried by place, so no name can clash.
    """

    def clean(rows: DataFrame, indexes: list) -> DataFrame:
        def judge():
            def keep(column: pa.Array) -> pa.Array:
                good = np.ones(len(column), bool)
                for shared in indexes:
                    for a, _, h, bounds in batches(column):
                        for r, _ in shared.value.search(h, bounds):
                            good[a + r] = False
                return pa.array(good)

            return keep

        return filter_rows(rows, text_col, judge)

    left, waiting, store = docs, None, None
    for number, indexes in enumerate(passes(docs, benchmark, text_col, item_col, item_text, **parameters)):
        if waiting is not None:
            store = store or Store(docs.sparkSession)
            plain = left.toDF(*(f"c{i}" for i in range(len(docs.columns))))
            kept = clean(plain.toDF(*docs.columns), waiting).toDF(*plain.columns)
            left = store.keep(kept, f"left-{number}").toDF(*docs.columns)
            for shared in waiting:
                shared.unpersist()
        waiting = indexes
    return docs if waiting is None else clean(left, waiting)
