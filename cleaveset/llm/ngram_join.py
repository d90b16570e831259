"""N-gram Jaccard join: prefix trees of globally ordered shingle sets within blocks that share rare shingles.

1. Each text becomes its set of distinct shingle hashes. Equal sets form a class; one document represents it.
2. Two linked sets differ in so few shingles that each has fewer than ``|x| - ceil(t |x|) + 1`` shingles of its own.
   Exact counts of all shingles leave the few classes with so many shared ones. Shingles are exchanged as packed arrays:
   a map task keeps a class once, however many copies it has, and a shingle that two of its classes have goes on as a
   bare mark, so neither a text copied a million times nor a line that half of all texts hold fills a range.
3. Those are ordered by (number of classes, hash). Linked sets share one of the first ``|x| - ceil(t |x|) + 1`` of that
   order, so components over shared prefix shingles are blocks without links between them.
4. A block's sets are stored in a prefix tree. All sets walk it at once, sharing the overlaps of common paths; a subtree
   is left by the sets that can't reach the threshold with what remains below. Large blocks are cut by size into bands,
   of which only neighbouring ones can have links, and bands into chunks; pairs of chunks are the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.llm._exchange import Ranges, regroup
from cleaveset.llm._graph import components, union
from cleaveset.llm._store import Store
from cleaveset.llm._words import batches, mix, runs

WORDS = 5
#: A pair links when DEN * |x & y| >= NUM * |x | y|.
NUM, DEN = 80, 100
#: Bytes of shingles that one range of the count exchange should hold.
RANGE_BYTES = 10_000_000
#: Shingles that a map task gathers before it sends them on: some 60 bytes each while they are merged.
HELD = 1_500_000
#: Bytes of an Arrow batch that a map task returns, about; the JVM holds a batch beside its heap.
SENT_BYTES = 2_000_000
#: Bytes of keys that are broadcast at most.
BROADCAST_BYTES = 64_000_000


def shingles(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; the whole sequence if it has fewer than n words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < n:
        return runs(h, len(h))
    return np.unique(runs(h, n))


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit digests of a shingle set."""
    if not len(s):
        return 0, 0
    a = np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True)
    b = np.add.reduce(mix(s + np.uint64(0x1234567)), keepdims=True)
    one = mix(a * np.uint64(3) + b + np.uint64(len(s)))
    two = mix(mix(b) * np.uint64(5) + a + np.uint64(0x51ED270B))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


class Names:
    """Names of classes: the first digest, but for sets that share it with another set, told by the second.

    ``odd`` has the smallest second digest of each first one that several sets have: with 64 bits, about n * n / 2 ** 65
    of n sets. ``bits`` shortens the first digest, for tests.
    """

    def __init__(self, odd: dict[int, int] | None = None, bits: int = 64):
        self.odd, self.mask = odd or {}, (1 << bits) - 1

    def both(self, s: np.ndarray) -> tuple[int, int]:
        one, two = digests(s)
        return (one if self.mask == (1 << 64) - 1 else one & self.mask), two

    def __call__(self, s: np.ndarray) -> int:
        one, two = self.both(s)
        if one in self.odd and self.odd[one] != two:
            return two
        return one


def sets(column: pa.Array, n: int = WORDS):
    """(row, shingle set) of each row of a text column."""
    for a, b, h, bounds in batches(column):
        for k in range(b - a):
            yield a + k, shingles(h[bounds[k] : bounds[k + 1]], n)


def prefix(n: np.ndarray | int, num: int, den: int):
    """How many shingles of a set of n can't all be missing from a linked set: n - ceil(t n) + 1."""
    return n - -(-num * n // den) + 1


def _classes(rows: DataFrame, kind: str, n: int, names: Names) -> DataFrame:
    def run(found):
        for b in found:
            size, one, two = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for k, s in sets(b.column(1), n):
                size[k] = len(s)
                one[k], two[k] = names.both(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size), pa.array(one), pa.array(two)], ["doc_id", "key", "n", "class", "second"])

    return rows.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {kind}, key string, n long, class long, second long")


def merge(tokens: np.ndarray, names: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of one class, that class, tokens of several), each sorted by token."""
    if len(tokens):
        order = np.argsort(tokens)
        tokens, names = tokens[order], names[order]
        del order
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        low = np.minimum.reduceat(names, start)
        one = low == np.maximum.reduceat(names, start)
        tokens = tokens[start]
        shared = np.unique(np.concatenate([shared, tokens[~one]]))
        tokens, names = tokens[one], low[one]
        if len(shared):
            at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
            alone = shared[at] != tokens
            tokens, names = tokens[alone], names[alone]
    else:
        shared = np.unique(shared)
    return tokens, names, shared


def _join(rows, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _loaded(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return merge(_join(rows, "tokens", np.uint64), np.repeat(_join(rows, "classes", np.int64), _join(rows, "counts", np.uint32)), _join(rows, "shared", np.uint64))


def _sent(merged: tuple, edges: np.ndarray, first: int) -> pa.RecordBatch:
    """Merged shingles by range: those of one class in the order of their classes, which are named once each."""
    tokens, names, shared = merged
    ends = lambda x: np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])
    cut, also = ends(tokens), ends(shared)
    out: list[list] = [[], [], [], [], []]
    for r in range(len(edges) + 1):
        t, c = tokens[cut[r] : cut[r + 1]], names[cut[r] : cut[r + 1]]
        if len(t) or also[r] < also[r + 1]:
            order = np.argsort(c, kind="stable")
            own, n = np.unique(c, return_counts=True)
            for o, v in zip(out, (first + r, t[order].tobytes(), own.tobytes(), n.astype(np.uint32).tobytes(), shared[also[r] : also[r + 1]].tobytes())):
                o.append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(o, pa.binary()) for o in out[1:])], ["range", "tokens", "classes", "counts", "shared"])


def _emptied(parts: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(parts)
    parts.clear()
    return out


def _pieces(batch: pa.RecordBatch):
    step = max(1, batch.num_rows * SENT_BYTES // max(1, batch.nbytes))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def _pack(texts: DataFrame, ranges: Ranges, n: int, names: Names, most: int) -> DataFrame:
    """A map task's shingles by range, each class once."""

    def run(found):
        own, parts, size = {}, [], 0
        edges = ranges.top_edges()
        flush = lambda: _pieces(_sent(merge(_emptied(parts), np.repeat(np.array(list(own), np.int64), list(own.values())), np.zeros(0, np.uint64)), edges, 0))
        for b in found:
            for _, s in sets(b.column(0), n):
                if len(s) and (name := names(s)) not in own:
                    own[name] = len(s)
                    parts.append(s)
                    size += len(s)
                if size > most:
                    yield from flush()
                    own, parts, size = {}, [], 0
        if parts:
            yield from flush()

    return texts.mapInArrow(run, "range int, tokens binary, classes binary, counts binary, shared binary")


def _own_counts(packed: DataFrame, ranges: Ranges, most: int) -> DataFrame:
    """(class, own): how many of a class's shingles occur in no other class."""

    def summed(names: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(names, return_inverse=True)
        return names, np.bincount(at, n, len(names)).astype(np.int64)

    def send(merged: tuple, edges: np.ndarray, first: int) -> pa.RecordBatch:
        names, n = merged
        cut = np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
        have = np.flatnonzero(cut[1:] > cut[:-1])
        return pa.RecordBatch.from_arrays([pa.array(have + first, pa.int32()), *(pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in have], pa.binary()) for x in (names, n.astype(np.uint32)))], ["range", "names", "n"])

    def load(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        return summed(_join(rows, "names", np.uint64), _join(rows, "n", np.uint32))

    def count(table: pa.Table) -> pa.Table:
        _, names, _ = _loaded(table.to_pylist())
        names, n = np.unique(names.view(np.uint64), return_counts=True)
        return pa.Table.from_batches([send((names, n), ranges.top_edges(), 0)])

    def total(table: pa.Table) -> pa.Table:
        names, n = load(table.to_pylist())
        return pa.table([pa.array(names.view(np.int64)), pa.array(n)], ["class", "own"])

    schema = "range int, tokens binary, classes binary, counts binary, shared binary"
    counted = ranges.by_range(regroup(packed, ranges, _loaded, _sent, schema, "tokens", 8 * most)).applyInArrow(count, "range int, names binary, n binary")
    return ranges.by_range(regroup(counted, ranges, load, send, "range int, names binary, n binary", "names", 8 * most)).applyInArrow(total, "class long, own long")


class Trie:
    """Compressed prefix tree of sets given as sorted arrays of dense shingle numbers."""

    def __init__(self, keys: list[np.ndarray]):
        order = sorted(range(len(keys)), key=lambda k: keys[k].astype(">u4").tobytes())
        self.nodes: list[list] = []  # [set that spells the path, depth above, depth, children, sets that end here, longest set below, shortest]
        root = self._node(order[0], 0, 0) if order else None
        path = [root] if order else []
        last = None
        for k in order:
            common = 0
            if last is not None:
                m = min(len(keys[last]), len(keys[k]))
                differ = np.flatnonzero(keys[last][:m] != keys[k][:m])
                common = int(differ[0]) if len(differ) else m
            while len(path) > 1 and self.nodes[path[-1]][1] >= common:
                path.pop()
            top = self.nodes[path[-1]]
            if top[2] > common:  # split the edge at the common depth
                lower = self._node(top[0], common, top[2])
                self.nodes[lower][3], self.nodes[lower][4] = top[3], top[4]
                top[2], top[3], top[4] = common, [lower], []
            if len(keys[k]) > common:
                child = self._node(k, common, len(keys[k]))
                top[3].append(child)
                path.append(child)
            self.nodes[path[-1]][4].append(k)
            last = k
        if order:
            self._bounds(keys)

    def _node(self, key: int, above: int, depth: int) -> int:
        self.nodes.append([key, above, depth, [], [], 0, 0])
        return len(self.nodes) - 1

    def _bounds(self, keys: list[np.ndarray]) -> None:
        stack, seen = [0], []
        while stack:
            at = stack.pop()
            seen.append(at)
            stack += self.nodes[at][3]
        for at in reversed(seen):
            sizes = [len(keys[k]) for k in self.nodes[at][4]] + [self.nodes[c][5] for c in self.nodes[at][3]]
            small = [len(keys[k]) for k in self.nodes[at][4]] + [self.nodes[c][6] for c in self.nodes[at][3]]
            self.nodes[at][5], self.nodes[at][6] = max(sizes), min(small)


def linked(stored: list[np.ndarray], asked: list[np.ndarray], num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked set, stored set) whose Jaccard similarity is at least num / den, by one walk of a prefix tree."""
    if not stored or not asked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_tokens = np.concatenate([*stored, *asked])
    tokens, number, freq = np.unique(all_tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -freq))] = np.arange(len(tokens))  # shared shingles first: long common paths
    number = rank[number]
    cuts = np.cumsum([0, *(len(s) for s in stored), *(len(s) for s in asked)])
    keys = [np.sort(number[cuts[k] : cuts[k + 1]]) for k in range(len(stored) + len(asked))]
    store, ask = keys[: len(stored)], keys[len(stored) :]
    size = np.array([len(a) for a in ask], np.int64)
    flat = np.concatenate(ask)
    who = np.repeat(np.arange(len(ask)), size)
    by = np.argsort(flat, kind="stable")
    who = who[by]
    post = np.searchsorted(flat[by], np.arange(len(tokens) + 1))
    trie = Trie(store)
    left, right = [], []
    stack = [(0, np.arange(len(ask)), np.zeros(len(ask), np.int64))]
    while stack:
        at, act, over = stack.pop()
        key, above, depth, children, ends, longest, shortest = trie.nodes[at]
        if depth > above:
            run = store[key][above:depth]
            n = post[run + 1] - post[run]
            first = np.repeat(post[run] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            hits = np.bincount(who[first + np.arange(n.sum())], minlength=len(ask))
            over = over + hits[act]
        # den * o >= num * (|x| + |y| - o) with the most that the rest of the longest set below can add
        most = np.minimum(over + longest - depth, size[act])
        open_ = (den + num) * most >= num * (size[act] + np.maximum(shortest, most))
        act, over = act[open_], over[open_]
        if not len(act):
            continue
        for k in ends:
            good = act[(den + num) * over >= num * (size[act] + depth)]
            left.append(good)
            right.append(np.full(len(good), k))
        for child in children:
            stack.append((child, act, over))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _walk(num: int, den: int, n: int, names: Names):
    """One task: the sets of a block's two chunks (or one) -> degrees of its classes and edges of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        side = np.array(table["side"].to_numpy())
        name = np.array(table["class"].to_numpy())
        weight = np.array(table["copies"].to_numpy())
        found = [s for _, s in sets(table["text"], n)]
        order, have = [], set()
        for k in np.lexsort((name, side)):  # a repeated id also brings other texts, and the same one again
            if (name[k], side[k]) not in have and names(found[k]) == name[k]:
                have.add((name[k], side[k]))
                order.append(int(k))
        first = [k for k in order if side[k] == 0]
        second = [k for k in order if side[k] == 1]
        same = table["band"][0].as_py() % 2 == 0 and bool(table["i"][0].as_py() == table["j"][0].as_py())
        a, b = linked([found[k] for k in first], [found[k] for k in (first if same else second)], num, den)
        y, x = np.array(first, np.int64)[b] if len(b) else b, np.array(first if same else second, np.int64)[a] if len(a) else a
        keep = name[x] != name[y]
        x, y = x[keep], y[keep]
        degree = np.bincount(x, weight[y], len(name))
        if not same:
            degree += np.bincount(y, weight[x], len(name))
        root = name.copy()
        if len(x):
            nodes, label = union(name[x], name[y])
            at = np.searchsorted(nodes, name)
            at[at == len(nodes)] = 0
            root = np.where(nodes[at] == name, label[at], name)
        some = np.flatnonzero(degree > 0)
        return pa.table([pa.array(name[some]), pa.array(degree[some].astype(np.int64)), pa.array(root[some])], ["class", "degree", "root"])

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, range_bytes: int = RANGE_BYTES, chunk_bytes: int = 8_000_000, broadcast_bytes: int = BROADCAST_BYTES, on_driver: int | None = None, held_shingles: int = HELD, fan: int | None = None, bits: int = 64, classes_too: bool = False) -> DataFrame:
    """Near-duplicate links of whole texts by Jaccard similarity of their word shingle sets.

    Returns one row for each row of ``docs``: doc_id, n_shingles, n_similar (other rows linked with it, copies
    included) and component_id (smallest id reachable by links). Every pair is decided by its sets of 64-bit shingle
    hashes; two shingles of one pair collide with a probability of |x| |y| / 2 ** 64. Equal sets are told by 128 bits.

    * Null text or a text without words has an empty set, no links and itself as its component. Fewer than ``words``
      words make one shingle. Very long texts are taken whole.
    * Repeated rows are rows of their own, linked with each other. Pairs exactly at the threshold link.
    * Rows with a null id take part; they count as links, and a component has the smallest id that isn't null.
    * An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    store = Store(spark)
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    named = store.keep(_classes(rows, kind, words, Names(bits=bits)), "rows")
    seconds = named.where("n > 0").groupBy("class").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b")
    names = Names({r["class"]: r.a for r in seconds.select("class", "a").collect()}, bits)  # about n * n / 2 ** 65 rows
    odd = spark.createDataFrame([(c, s) for c, s in names.odd.items()], "class long, first long")
    if names.odd:
        named = named.join(odd, "class", "left").withColumn("class", F.when(F.col("first") != F.col("second"), F.col("second")).otherwise(F.col("class"))).drop("first")
    named = named.drop("second").withColumn("class", F.when(F.col("n") > 0, F.col("class")))
    classes = named.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    classes = store.keep(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    ranges = Ranges(max(4, -(-8 * total // range_bytes)), fan)

    own = _own_counts(_pack(rows.select("text"), ranges, words, names, held_shingles), ranges, held_shingles)
    own = store.keep(own.where("own > 0"), "own")
    need = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    near = classes.join(own, "class", "left").where(F.coalesce("own", F.lit(0)) < need)
    near = store.keep(near.select("class", "n", "copies", "key"), "near")
    bounded = lambda t: F.broadcast(t) if (t.agg(F.sum(F.octet_length("key") + 60)).first()[0] or 0) <= broadcast_bytes else t
    texts = rows.join(bounded(near), "key").select("text", "class", "n")

    def shared(found):
        for b in found:
            keep, tokens = [], []
            own = b.column(1).to_pylist()
            for k, s in sets(b.column(0), words):
                if names(s) == own[k]:
                    keep.append(k)
                    tokens.append(pa.array(s.view(np.int64)))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(tokens) if tokens else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep, pa.int64())), b.column(2).take(pa.array(keep, pa.int64())), lists], ["class", "n", "tokens"])

    held = texts.mapInArrow(shared, "class long, n long, tokens array<long>")
    twice = named.groupBy("key").count().where("count > 1").limit(1).count() > 0
    held = held.dropDuplicates(["class"]) if twice else held  # else one row has the key
    token_rows = store.keep(held.select("class", "n", F.explode("tokens").alias("token")), "tokens")
    common = token_rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rare = token_rows.join(common, "token")
    first = rare.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    length = F.greatest(F.lit(0), (need - (F.col("n") - F.size("shared"))).cast("int"))
    postings = first.select("class", F.explode(F.slice("shared", F.lit(1), length)).alias("p")).select("class", F.col("p.token").alias("token"))
    postings = store.keep(postings, "postings")
    heads = postings.groupBy("token").agg(F.min("class").alias("a"), F.count("*").alias("k")).where("k > 1")
    edges = postings.join(heads, "token").where("a <> class").select("a", F.col("class").alias("b"))
    limit = {} if on_driver is None else {"on_driver": on_driver}
    blocks = store.keep(components(edges, store, "blocks", **limit).select(F.col("node").alias("class"), F.col("component").alias("block")), "block")

    # a block of one chunk is one task; larger ones are cut into bands of sizes, so that only neighbouring bands can link
    members = blocks.join(near, "class")
    sizes = members.groupBy("block").agg(F.sum("n").alias("total"))
    band = F.when(F.col("total") * 8 > chunk_bytes, F.floor(F.log("n") / math.log(1.001 * den / num))).otherwise(F.lit(0)).cast("int")
    banded = store.keep(members.join(sizes, "block").withColumn("band", band).select("key", "class", "copies", "n", "block", "band"), "banded")
    counts = banded.groupBy("block", "band").agg(F.ceil(8 * F.sum("n") / chunk_bytes).cast("int").alias("chunks"))
    above = counts.select("block", (F.col("band") - 1).alias("band"), F.col("chunks").alias("more"))
    below = counts.select("block", (F.col("band") + 1).alias("band"), F.col("chunks").alias("less"))
    counts = counts.join(above, ["block", "band"], "left").join(below, ["block", "band"], "left").na.fill(0, ["more", "less"])
    placed = banded.join(counts, ["block", "band"]).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda low, i, j, side: F.struct(low.cast("int").alias("band"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    here = F.col("chunk")
    same = F.transform(upto("chunks"), lambda o: task(F.col("band") * 2, F.least(here, o), F.greatest(here, o), F.when(here <= o, 0).otherwise(1)))
    up = F.transform(upto("more"), lambda o: task(F.col("band") * 2 + 1, here, o, F.lit(0)))
    down = F.transform(upto("less"), lambda o: task(F.col("band") * 2 - 1, o, here, F.lit(1)))
    tasks = placed.select("key", "class", "copies", "block", F.explode(F.concat(same, up, down)).alias("task")).select("key", "class", "copies", "block", "task.*")
    tasks = store.keep(tasks, "tasks")
    listed = rows.join(bounded(tasks), "key").drop("doc_id", "key")
    found = listed.groupBy("block", "band", "i", "j").applyInArrow(_walk(num, den, words, names), "class long, degree long, root long")
    found = store.keep(found, "links")
    joined = components(found.select(F.col("root").alias("a"), F.col("class").alias("b")), store, "joined", **limit).select(F.col("node").alias("class"), "component")
    degree = found.groupBy("class").agg(F.sum("degree").alias("degree"))
    labelled = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = labelled.join(joined.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    info = classes.where("copies > 1").select("class").union(joined.select("class")).distinct()
    info = classes.join(info, "class").join(joined, "class", "left").join(lowest, "component", "left").join(degree, "class", "left")
    hot = F.col("copies") > 1_000_000
    info = info.select("class", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "class").alias("component"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_similar"), F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))).alias("salt"), hot.alias("hot"))
    info = store.keep(info, "info")
    hot_names = [r["class"] for r in info.where("hot AND salt = 0").select("class").collect()] if info.where("hot").limit(1).count() else []  # at most rows / 1,000,000 of them
    salt = F.when(F.col("class").isin(hot_names), F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")).otherwise(F.lit(0)) if hot_names else F.lit(0)
    result = named.withColumn("salt", salt).join(info.drop("hot"), ["class", "salt"], "left")
    more = (F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("component", "class", F.lit(0)).alias("component")) if classes_too else ()
    return result.select(result["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay when each group of linked texts keeps the one of smallest id, with their columns.

    Rows whose id is null or repeated are told apart by their texts; of equal ones one stays. Null texts and texts
    without words are linked with nothing and stay. Very long texts are compared whole. Columns are carried in a struct,
    so no name can clash; an empty table gives an empty one.
    """
    store = Store(docs.sparkSession)
    result = store.keep(jaccard_join(docs, id_col, text_col, classes_too=True), "result")
    own = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("whole"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    unclear = store.keep(result.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("i")), "unclear")
    gone = result.where("doc_id <> component_id").select(F.col("doc_id").alias("i"))
    drop = store.keep(gone.union(unclear.where("i IS NOT NULL")).distinct(), "drop")
    small = lambda t: F.broadcast(t) if (t.agg(F.sum(F.octet_length(F.col("i").cast("string")) + 24)).first()[0] or 0) <= broadcast_bytes else t
    clear = own.where("i IS NOT NULL").join(small(drop), "i", "left_anti").select("whole.*")
    if not unclear.limit(1).count():
        return clear
    # a row of an unclear id finds its result by the digests of its text, computed as the join computed them
    again = own.join(small(unclear).withColumnRenamed("i", "u"), F.col("i").eqNullSafe(F.col("u")), "left_semi")

    def name(found):
        for b in found:
            one, two = (np.zeros(b.num_rows, np.int64) for _ in range(2))
            for k, s in sets(b.column(1)):
                one[k], two[k] = digests(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(one), pa.array(two), b.column(2)], ["i", "one", "two", "whole"])

    with_names = again.select("i", "t", "whole").mapInArrow(name, again.select("i", F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), "whole").schema)
    right = result.select(F.col("doc_id").alias("d"), F.col("class").alias("c"), "component", "component_id", "n_shingles").distinct()
    judged = with_names.join(right, F.col("i").eqNullSafe(F.col("d")) & F.col("c").isin(F.col("one"), F.col("two"))).where(F.col("d").eqNullSafe(F.col("component_id")))
    kept = judged.where("n_shingles = 0").select("whole").unionByName(judged.where("n_shingles > 0").dropDuplicates(["component"]).select("whole"))
    return clear.unionByName(kept.select("whole.*"))
