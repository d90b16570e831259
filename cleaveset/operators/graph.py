"""Graphs of similarity: components, spectral orders and the global minimum cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.operators import pairwise
from cleaveset.operators.blocks import Blocks, exact, inside, matrix, numbered, pairs_exact, renamed, same_ids, tiles

#: Rows up to which one worker holds the n x n matrix; more are swept by blocks that are made again for each product.
DENSE_ROWS = 3000
#: Vectors that a sweep multiplies, basis after which the search starts again from the best, sweeps at most.
WIDTH, BASIS, SWEEPS = 12, 72, 60
#: A residual of this size, of eigenvalues up to 2, ends the search.
ENOUGH = 2e-9


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), by large-star and small-star rounds.

    The lineage of a round is cut by a checkpoint in the shared folder.
    """
    spark = nodes.sparkSession
    ensure_checkpoints(spark)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(low, "u").select(pair.alias("p")).select("p.u", "p.v").where("u <> v").distinct().checkpoint()
        changed = small.exceptAll(now).limit(1).count() + now.exceptAll(small).limit(1).count()
        now = small
        if not changed:
            break
    return nodes.select("id").join(now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def ensure_checkpoints(spark) -> None:
    """Checkpoints go where spark.checkpoint.dir says; only a local session without it gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            where = "file://" + tempfile.mkdtemp(prefix="cleaveset-")
        spark.sparkContext.setCheckpointDir(where)


def sigma(df: DataFrame, metric: str = "euclidean") -> float:
    """Median of the positive distances; 1 where there is none."""
    return pairwise.pair_quantile(df, 0.5, metric, positive=True) or 1.0


def _sides(x: np.ndarray, metric: str, s: float) -> np.ndarray:
    w = np.exp(-(np.vstack([pairwise.distances(x[a : a + 512], x, metric) for a in range(0, len(x), 512)]) ** 2) / (2 * s * s))
    np.fill_diagonal(w, 0.0)
    return w


def sparsify(w: np.ndarray, threshold: float | None) -> np.ndarray:
    positive = w[w > 0]
    limit = (np.median(positive) if len(positive) else 0.0) if threshold is None else threshold
    return np.where(w >= limit, w, 0.0)


def second_vector(w: np.ndarray, guard: float) -> np.ndarray:
    """Eigenvector of the second smallest eigenvalue of I - D^-1/2 W D^-1/2; its largest entry is positive."""
    d = w.sum(1)
    inv = np.where(d + guard > 0, 1 / np.sqrt(np.maximum(d + guard, 1e-300)), 0.0)
    _, vectors = np.linalg.eigh(np.eye(len(w)) - inv[:, None] * w * inv[None, :])
    v = vectors[:, 1]
    top = int(np.argmax(np.round(np.abs(v), 9)))
    return v if v[top] > 0 else -v


def spectral_scores(df: DataFrame, metric: str = "euclidean", threshold: float | None = None, thresholded: bool = True, guard: float = 0.0, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """(id, score): entries of the second eigenvector of the similarity graph.

    Up to DENSE_ROWS by one dense kernel, beyond by products of the graph with few vectors at a time.
    """
    kind = df.schema["id"].dataType.simpleString()
    if df.count() > dense_rows:
        return Similarities(df, metric, threshold, thresholded).second_vector(guard, kind)
    s = sigma(df, metric)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        w = _sides(np.array(pdf.e.tolist()), metric, s)
        v = second_vector(sparsify(w, threshold) if thresholded else w, guard)
        return pd.DataFrame({"id": pdf.id, "score": np.round(v, 9)})

    return df.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, f"id {kind}, score double")


def stoer_wagner(w: np.ndarray) -> list[int]:
    """One side of a global minimum cut of a connected weighted graph."""
    w = w.copy()
    groups = [[i] for i in range(len(w))]
    left = list(range(len(w)))
    best, side = np.inf, []
    while len(left) > 1:
        weight = w[left[0], :].copy()
        inside = np.zeros(len(w), bool)
        gone = np.ones(len(w), bool)
        gone[left] = False
        inside[left[0]] = True
        before = last = left[0]
        for _ in range(len(left) - 1):
            score = np.where(inside | gone, -np.inf, weight)
            before, last = last, int(score.argmax())
            cut = weight[last]
            inside[last] = True
            weight = weight + w[last]
        if cut < best:
            best, side = cut, list(groups[last])
        groups[before] += groups[last]
        w[before] += w[last]
        w[:, before] += w[:, last]
        w[before, before] = 0
        left.remove(last)
    return side


def min_cut_sides(df: DataFrame, ratio: float, threshold: float | None = None, metric: str = "euclidean", seed: int = 42, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """(id, split) of the Stoer-Wagner method.

    Disconnected: smaller components are test, the largest is cut in seeded order. Connected: one side of the global
    minimum cut, filled up or trimmed in seeded order to the size of train. Beyond DENSE_ROWS the least row sum is that
    cut where a bound proves it; else the method's phases make the rows of the graph as they need them, which takes no
    n x n matrix but as many products of all pairs as there are rows.
    """
    kind = df.schema["id"].dataType.simpleString()
    if df.count() > dense_rows:
        return Similarities(df, metric, threshold, True).cut_sides(ratio, seed, kind)
    s = sigma(df, metric)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        w = sparsify(_sides(np.array(pdf.e.tolist()), metric, s), threshold)
        n, k = len(w), int(len(w) * ratio)
        order = np.random.RandomState(seed).permutation(n)
        label = np.arange(n)
        while True:
            low = np.minimum(label, np.where(w > 0, label[None, :], n).min(1, initial=n))
            if (low == label).all():
                break
            label = low
        names, sizes = np.unique(label, return_counts=True)
        if len(names) > 1:
            big = [i for i in order if label[i] == names[sizes.argmax()]]
            train = set(big[: int(len(big) * ratio)])
        else:
            side = set(stoer_wagner(w))
            first = [i for i in order if i in side]
            train = set((first + [i for i in order if i not in side])[:k])
        return pd.DataFrame({"id": pdf.id, "split": ["train" if i in train else "test" for i in range(n)]})

    return df.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, f"id {kind}, split string")


class Similarities:
    """The similarity graph of more rows than a dense kernel takes: its tiles are made, used and dropped in tasks.

    The driver and each task hold a few numbers a row. Rows are in the order of their ids, as in the dense kernels.
    """

    def __init__(self, df: DataFrame, metric: str, threshold: float | None, thresholded: bool, block_rows: int | None = None):
        self.spark, self.metric = df.sparkSession, metric
        df, self.names = numbered(df.select("id", "e"))
        rows = df.where("e IS NOT NULL")
        self.ids = np.sort(rows.select("id").toArrow()["id"].to_numpy().astype(np.int64))
        self.df, self.n = df, len(self.ids)
        self.sigma = sigma(df, metric)
        self.limit = np.inf  # the largest distance that is an edge
        if thresholded and threshold is None:
            middle = pairwise.pair_places(df, lambda n: [(n - 1) / 2], metric)
            self.limit = middle[0][0] if middle else np.inf
        elif thresholded:
            self.limit = float(np.sqrt(max(0.0, -2 * np.log(threshold))) * self.sigma) if threshold > 0 else np.inf
        self.blocks = Blocks(df, metric, block_rows)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("blocks", "metric", "limit", "sigma")}

    def tile(self, left, right, rows: slice, cols: slice) -> np.ndarray:
        """Weights of a tile; those of single-precision products where their error is below 1e-4, edges always exact."""
        measure, spread = self.blocks.measure, 2 * self.sigma**2
        g, slack = measure.tile(left, right, rows, cols)
        scale = 2 / (spread * measure.scale**2)
        if measure.product and self.metric == "euclidean" and slack * scale < 1e-4:
            w = np.exp(g * np.float32(scale)).astype(float)
        else:
            d = pairwise.distances(left.x[rows], right.x[cols], self.metric)
            w = np.exp(d * d / -spread)
        if np.isfinite(self.limit):
            band = 1e-12 * (1 + self.limit)
            near, maybe = g > float(measure.at(self.limit - band)) + slack, g >= float(measure.at(self.limit + band)) - slack
            maybe ^= near
            if len(at := np.flatnonzero(maybe)):
                i, j = np.divmod(at, g.shape[1])
                near.ravel()[at] = pairs_exact(left, right, rows.start + i, cols.start + j, self.metric) <= self.limit
            w *= near
        return w

    def product(self, v: np.ndarray, squares: bool = False) -> np.ndarray:
        """The graph times the columns of ``v``, a block of rows a task; with ``squares`` the rows' sums of squares, too."""
        own, given = self.blocks, self.spark.sparkContext.broadcast((self.ids, v))
        wide = v.shape[1] + squares

        def work(i: int):
            ids, v = given.value
            load, block = own.loader(), own.loader()(i)
            if block is None:
                return
            out = np.zeros((block.n, wide))
            for j in np.flatnonzero(own.rows):
                there = load(int(j))
                pairs, other = same_ids(block, there), v[np.searchsorted(ids, there.id)]
                for rows, cols in tiles(block, there):
                    w = self.tile(block, there, rows, cols)
                    w[inside(pairs, rows, cols)] = 0.0
                    out[rows, : v.shape[1]] += w @ other[cols]
                    if squares:
                        out[rows, -1] += np.einsum("ij,ij->i", w, w)
            yield pa.table([np.searchsorted(ids, block.id), pa.array(list(out), pa.list_(pa.float64()))], ["p", "v"])

        found = own.each(work, "p long, v array<double>").toArrow()
        given.destroy()
        out = np.zeros((self.n, wide))
        out[found["p"].to_numpy()] = matrix(found, "v")
        return out

    def largest(self, product, skip: np.ndarray, enough: float) -> tuple[float, np.ndarray, float]:
        """(eigenvalue, vector, residual): the largest of a symmetric product beside those of the unit columns ``skip``.

        A block Krylov space with Rayleigh-Ritz steps; it starts again from its best vectors when it is full.
        """
        clean = lambda x: x - skip @ (skip.T @ x)
        rng = np.random.RandomState(0)
        x = np.linalg.qr(clean(rng.randn(self.n, min(WIDTH, max(1, self.n - skip.shape[1])))))[0]
        basis, image = np.zeros((self.n, 0)), np.zeros((self.n, 0))
        for _ in range(SWEEPS):
            y = clean(product(x))
            basis, image = np.hstack([basis, x]), np.hstack([image, y])
            small = basis.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            best = turn[:, ::-1][:, : x.shape[1]]
            ritz, moved = basis @ best, image @ best
            rest = moved - ritz * values[::-1][: x.shape[1]]
            residual = float(np.linalg.norm(rest[:, 0]))
            if residual <= enough or basis.shape[1] + x.shape[1] > self.n - skip.shape[1]:
                break
            if basis.shape[1] + x.shape[1] > BASIS:
                basis, image = basis @ turn[:, ::-1][:, : 2 * x.shape[1]], image @ turn[:, ::-1][:, : 2 * x.shape[1]]
            for _ in range(2):  # twice is enough to be orthogonal
                rest = clean(rest)
                rest -= basis @ (basis.T @ rest)
                rest = np.linalg.qr(rest)[0]
            x = rest
        return float(values[-1]), ritz[:, 0], residual

    def second_vector(self, guard: float, kind: str) -> DataFrame:
        d = self.product(np.ones((self.n, 1)))[:, 0]
        inv = np.where(d + guard > 0, 1 / np.sqrt(np.maximum(d + guard, 1e-300)), 0.0)[:, None]
        turned = lambda x: inv * self.product(inv * x)
        if guard:  # the first vector is only near the known one
            first = np.zeros((self.n, 0))
            _, v, _ = self.largest(turned, first, ENOUGH)
            first = v[:, None]
        else:
            first = np.sqrt(np.maximum(d, 0))[:, None]
            first = first / max(1e-300, np.linalg.norm(first))
        _, v, residual = self.largest(turned, first, ENOUGH)
        if residual > 1e3 * ENOUGH:
            raise ArithmeticError(f"the second eigenvector isn't found to {1e3 * ENOUGH:g}: residual {residual:g}")
        top = int(np.argmax(np.round(np.abs(v), 9)))
        v = np.round(v if v[top] > 0 else -v, 9)
        return self.table(v, "score double", kind)

    def table(self, values: np.ndarray, column: str, kind: str) -> DataFrame:
        out = self.spark.createDataFrame(pa.table([self.ids, pa.array(values)], ["id", column.split()[0]]))
        return renamed(out, self.names, "id").withColumn("id", F.col("id").cast(kind)) if self.names is None else renamed(out, self.names, "id")

    def cut_sides(self, ratio: float, seed: int, kind: str) -> DataFrame:
        order, k = np.random.RandomState(seed).permutation(self.n), int(self.n * ratio)
        parts = components(self.df.select("id"), pairwise.links(self.df, min(self.limit, 1e300), self.metric)).toArrow()
        label = parts["component"].to_numpy()[np.argsort(parts["id"].to_numpy())]
        names, sizes = np.unique(label, return_counts=True)
        train = np.zeros(self.n, bool)
        if len(names) > 1:
            big = order[label[order] == names[sizes.argmax()]]
            train[big[: int(len(big) * ratio)]] = True
        else:
            side = self.minimum_cut()
            train[np.concatenate([order[side[order]], order[~side[order]]])[:k]] = True
        return self.table(np.where(train, "train", "test"), "split string", kind)

    def minimum_cut(self) -> np.ndarray:
        """The side of a global minimum cut that the first row isn't on.

        A cut of s rows is at least s * least - s * (s - 1), as no edge is above 1, so the least row sum is minimal among
        those with s up to it. One with more rows on both sides is at least s * (n - s) / n times the second eigenvalue of
        the Laplacian, and that is at least the least row sum minus the largest eigenvalue of the graph across the ones.
        With T the graph on a few directions, this is at most T's plus the root of the squares that T leaves out.
        """
        n, one = self.n, np.full((self.n, 1), self.n**-0.5)
        first = self.product(np.ones((n, 1)), squares=True)
        d, least = first[:, 0], float(first[:, 0].min())
        at, s = int(d.argmin()), min(np.floor(least), n / 2)
        side = np.arange(n) == at
        side = side if at else ~side
        if s >= n / 2:
            return side
        squares = first[:, 1].sum() - 2 * (d * d).sum() / n + (d.sum() / n) ** 2
        clean = lambda x: x - one @ (one.T @ x)
        basis, image, x = np.zeros((n, 0)), np.zeros((n, 0)), np.linalg.qr(clean(np.random.RandomState(0).randn(n, 2 * WIDTH)))[0]
        while basis.shape[1] + x.shape[1] <= min(2 * BASIS, n // 2):
            y = clean(self.product(x))
            basis, image = np.hstack([basis, x]), np.hstack([image, y])
            small = basis.T @ image
            bound = least - max(0.0, np.linalg.eigvalsh((small + small.T) / 2)[-1]) - np.sqrt(max(0.0, squares - (small * small).sum()))
            if bound * s * (n - s) / n > least * (1 + 1e-6):
                return side
            x = clean(y)
            for _ in range(2):
                x = np.linalg.qr(clean(x - basis @ (basis.T @ x)))[0]
        return self.phases()

    def phases(self) -> np.ndarray:
        """Stoer-Wagner's phases in one task, with each row of the graph made when it is needed: linear memory."""
        limit, metric, spread, ids = self.limit, self.metric, 2 * self.sigma**2, self.ids

        def run(t: pa.Table) -> pa.Table:
            x = matrix(t.sort_by("id"))
            n = len(x)
            label, left, best, side = np.arange(n), n, np.inf, np.zeros(n, bool)

            def row(i: int) -> np.ndarray:
                e = exact(np.broadcast_to(x[i], x.shape), x, metric)
                w = np.where(e <= limit, np.exp(e * e / -spread), 0.0)
                w[i] = 0.0
                return w

            while left > 1:
                weight, seen, before, last = np.zeros(n), np.zeros(n, bool), label[0], label[0]
                for step in range(left):
                    if step:
                        score = np.where(seen | (label != np.arange(n)), -np.inf, np.bincount(label, weight, n))
                        before, last = last, int(score.argmax())
                        cut = score[last]
                    seen[last] = True
                    for i in np.flatnonzero(label == last):
                        weight += row(i)
                if cut < best:
                    best, side = cut, label == last
                label[label == last] = before
                # a group's name is one of its rows
                left -= 1
            return pa.table({"id": ids[side]})

        found = self.df.where("e IS NOT NULL").select("id", "e", F.lit(0).alias("_g")).groupBy("_g").applyInArrow(run, "id long").toArrow()
        return np.isin(ids, found["id"].to_numpy())
