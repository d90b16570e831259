"""Nearest neighbours by vantage-point trees, one per shard, searched by blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128
SLACK = 1e-7  # far above the rounding of matrix products, far below any gap that matters


class Tree:
    """Vantage-point tree over unit vectors; a node splits its points at the median distance from one of them."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.nodes: list[tuple] = []  # (vantage, radius, inside, outside) or (None, points)
        self.root = self._build(np.arange(len(x)), leaf) if len(x) else -1

    def _build(self, points: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        if len(points) <= leaf:
            self.nodes.append((None, points))
            return at
        self.nodes.append(())
        vantage, rest = points[0], points[1:]
        d = distance(self.x[rest] @ self.x[vantage])
        radius = float(np.partition(d, len(d) // 2)[len(d) // 2])
        inside = d <= radius
        if inside.all():
            inside = np.arange(len(rest)) < len(rest) // 2
        self.nodes[at] = (vantage, radius, self._build(rest[inside], leaf), self._build(rest[~inside], leaf), float(d[~inside].min()))
        return at


def distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))


def sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def search(tree: Tree, raw: np.ndarray, norm: np.ndarray, ids: np.ndarray, q: np.ndarray, q_raw: np.ndarray, q_norm: np.ndarray, q_ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, point numbers) of the k best of each query, -inf and -1 where there are fewer.

    A child is skipped for the queries whose k-th distance, divided by ``factor``, is below the least distance that the
    triangle inequality allows there. Matrix products choose candidates; the exact cosine decides, ties by smaller id.
    """
    score = np.full((len(q), k), -np.inf)
    found = np.full((len(q), k), -1, np.int64)

    def offer(act: np.ndarray, points: np.ndarray, dots: np.ndarray) -> None:
        a, p = np.nonzero((dots >= score[act, -1][:, None] - SLACK) & (ids[points][None, :] != q_ids[act][:, None]))
        if not len(a):
            return
        who, point = act[a], points[p]
        exact = np.concatenate([sequential(q_raw[who[i : i + 65536]], raw[point[i : i + 65536]]) for i in range(0, len(who), 65536)]) / (q_norm[who] * norm[point])
        mine = np.unique(who)
        who = np.concatenate([who, np.repeat(mine, k)])
        point = np.concatenate([point, found[mine].ravel()])
        exact = np.concatenate([exact, score[mine].ravel()])
        order = np.lexsort((np.where(point < 0, np.iinfo(np.int64).max, ids[point]), -exact, who))
        who, point, exact = who[order], point[order], exact[order]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.concatenate([first, [len(who)]])))
        keep = rank < k
        found[who[keep], rank[keep]] = point[keep]
        score[who[keep], rank[keep]] = exact[keep]

    def reach(act: np.ndarray) -> np.ndarray:
        return distance(np.maximum(score[act, -1], -1.0)) / factor + SLACK ** 0.5

    stack = [(tree.root, np.arange(len(q)), np.zeros(len(q)))] if tree.root >= 0 else []
    while stack:
        at, act, gap = stack.pop()
        open_ = gap <= reach(act)
        act = act[open_]
        if not len(act):
            continue
        node = tree.nodes[at]
        if node[0] is None:
            if len(node[1]):
                offer(act, node[1], q[act] @ tree.x[node[1]].T)
            continue
        vantage, radius, inside, outside, beyond = node
        dots = q[act] @ tree.x[vantage]
        offer(act, np.array([vantage]), dots[:, None])
        d = distance(dots)
        near = d <= radius
        stack.append((outside, act[near], (beyond - d)[near]))
        stack.append((inside, act[~near], (d - radius)[~near]))
        stack.append((outside, act[~near], np.zeros((~near).sum())))
        stack.append((inside, act[near], np.zeros(near.sum())))
    return score, found


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, norms, number of the vector among those of its id) of rows that take part, repeated rows once."""
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ids = np.array(table.column("i").to_numpy(), np.int64)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(len(ids), -1)
    norm = np.sqrt(sequential(x, x))
    ok = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
    ids, x, norm = ids[ok], x[ok], norm[ok]
    if len(ids):
        order = np.lexsort((*x.T[::-1], ids))
        ids, x, norm = ids[order], x[order], norm[order]
        fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)])
        ids, x, norm = ids[fresh], x[fresh], norm[fresh]
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        number = np.arange(len(ids)) - np.repeat(start, np.diff(np.concatenate([start, [len(ids)]])))
        mixed = np.argsort(np.random.RandomState(7).permutation(len(ids)), kind="stable")
        return ids[mixed], x[mixed], norm[mixed], number[mixed]
    return ids, x, norm, np.zeros(0, np.int64)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, factor: float = 1.0, shard_rows: int = 8192, query_block: int = 32768) -> DataFrame:
    """The k rows of largest cosine for each row whose id is divisible by ``every``, its own id excepted.

    Rows are hashed to shards of about ``shard_rows`` and queries to blocks of about ``query_block``; each pair of a
    shard and a block is one task of bounded size, which builds the shard's tree and searches it for the whole block.
    ``factor`` above 1 prunes more than the triangle inequality allows; 1 is exact search.

    Rows whose id or vector is null, or whose vector is empty, zero or has a null or non-finite component take no part;
    vectors are compared with those of their own length only. Equal rows count once; different vectors of one id are
    rows of their own, and as queries are ranked apart. Ties go to the smaller id. Other columns are ignored. An empty
    table gives an empty result; a query with fewer than k candidates gets all.
    """
    if factor < 1 or k < 1:
        raise ValueError("factor must be at least 1, k positive")
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"), F.size(vector_col).alias("d")).where("i IS NOT NULL AND v IS NOT NULL AND d > 0")
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("i") % every == 0, 1)).alias("q")).first()
    shards, blocks = max(1, -(-sizes.n // shard_rows)), max(1, -(-sizes.q // query_block))
    place = F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("i", F.lit(1)), F.lit(blocks)).cast("int")
    data = rows.select("i", "v", "d", place.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    asked = rows.where(F.col("i") % every == 0).select("i", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), block.alias("b"))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query_no", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        ids, raw, norm, _ = _vectors(left)
        q_ids, q_raw, q_norm, q_no = _vectors(right)
        parts = [[], [], [], []]
        if len(ids) and len(q_ids):
            tree = Tree(raw / norm[:, None])
            for a in range(0, len(q_ids), 2048):
                e = a + 2048
                score, found = search(tree, raw, norm, ids, q_raw[a:e] / q_norm[a:e, None], q_raw[a:e], q_norm[a:e], q_ids[a:e], k, factor)
                r, c = np.nonzero(found >= 0)
                for out, x in zip(parts, (q_ids[a:e][r], q_no[a:e][r], ids[found[r, c]], score[r, c])):
                    out.append(x)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in zip(parts, kinds)], names)

    hits = data.groupBy("d", "s", "b").cogroup(asked.groupBy("d", "s", "b")).applyInArrow(join, "query_id long, query_no long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
