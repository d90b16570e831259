"""Vectors as blocks of the shared folder, and sweeps over pairs of blocks.

A table is written once, as one file a block. A task owns a block and reads the others one after the other, so rows are
neither copied for each pair of blocks nor shuffled, and a task holds two blocks and one tile of their distances. Blocks
of few components are cells of a k-d tree, so pairs of cells that can't matter are skipped by their bounds; others are
cut by a hash of the id. Tiles of many components come from single-precision products with a bound of their error; every
pair whose decision is within that bound is computed again by ``exact``.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleaveset.operators.ranking import placed
from cleaveset.store import Store

#: Vectors of at most so many components are compared component by component, in cells of space.
LOW = 8
#: A table has about so many blocks, as long as these have LEAST to MOST rows; cells of space have LEAF.
BLOCKS, LEAST, MOST, LEAF = 60, 1024, 65536, 1024
#: Rows and columns of a tile.
TILE, STRIP = 512, 4096
#: Rows from which the cells of space are laid out.
PLAN = 100_000
#: Unit roundoff of single precision.
UNIT = 2.0**-24
SLACK = 1e-12
KEPT = 64


def matrix(table, name: str = "e") -> np.ndarray:
    lists = table.column(name)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(table.num_rows, -1)


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``, summed from the first component to the last."""
    out, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        x, y = a[:, j], b[:, j]
        if metric in ("euclidean", "sqeuclidean"):
            out += (x - y) * (x - y)
        elif metric == "cityblock":
            out += np.abs(x - y)
        elif metric == "chebyshev":
            np.maximum(out, np.abs(x - y), out=out)
        elif metric == "cosine":
            out += x * y
            aa += x * x
            bb += y * y
        else:
            raise ValueError(f"Unknown metric: {metric}")
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - out / (np.sqrt(aa) * np.sqrt(bb))
    return np.sqrt(out) if metric == "euclidean" else out


def away(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded as SQL rounds doubles: halves away from zero."""
    if digits is None:
        return x
    y = x * 10.0**digits
    whole = np.trunc(y)
    return np.where(np.abs(y - whole) == 0.5, whole + np.sign(y), np.rint(y)) / 10.0**digits


class Measure:
    """Closeness of pairs: the larger, the nearer. ``at`` is the closeness of a distance."""

    def __init__(self, metric: str, d: int, centre: np.ndarray, scale: float):
        self.metric, self.d, self.centre, self.scale = metric, d, centre, scale
        self.product = d > LOW and metric in ("euclidean", "sqeuclidean", "cosine")

    def at(self, t):
        t = np.asarray(t, float)
        if not self.product:
            return -t
        out = {"euclidean": -t * np.abs(t) / 2, "sqeuclidean": -t / 2, "cosine": -t}[self.metric] * self.scale**2
        return np.where(t < 0, np.inf, out) if self.metric != "cosine" else out

    def distance(self, g: float) -> float:
        if not self.product:
            return -g
        g = -g / self.scale**2
        return float(np.sqrt(2 * max(g, 0.0)) if self.metric == "euclidean" else 2 * g if self.metric == "sqeuclidean" else g)

    def sides(self, x: np.ndarray):
        """(left factor, right factor, largest half square): a product of both is minus half the squared distance."""
        if not self.product:
            return x, x, 0.0
        z = x / np.sqrt((x * x).sum(1))[:, None] if self.metric == "cosine" else x
        z = (z - self.centre) * self.scale
        h = (z * z).sum(1)[:, None] / 2
        one = np.ones_like(h)
        return np.hstack([z, -h, one]).astype(np.float32), np.hstack([z, one, -h]).astype(np.float32), float(h.max(initial=0.0))

    def tile(self, left: Block, right: Block, rows: slice, cols: slice) -> tuple[np.ndarray, float]:
        """(closeness, bound of its error)."""
        if self.product:
            return left.a[rows] @ right.b[cols].T, (self.d + 10) * UNIT * 2 * (left.top + right.top)
        x, y = left.a[rows], right.b[cols]
        if self.metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                return (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))) - 1, SLACK
        out = np.zeros((len(x), len(y)))
        for j in range(self.d):
            step = x[:, j, None] - y[None, :, j]
            if self.metric == "chebyshev":
                np.maximum(out, np.abs(step, out=step), out=out)
            elif self.metric == "cityblock":
                out += np.abs(step, out=step)
            else:
                step *= step
                out += step
        if self.metric == "euclidean":
            np.sqrt(out, out=out)
        return np.negative(out, out=out), 0.0


class Block:
    def __init__(self, table: pa.Table, d: int, measure: Measure, copies: int = 0):
        v = table["v"].combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        self.n = table.num_rows
        flat = np.frombuffer(v.buffers()[2], np.float64)[: self.n * d] if self.n else np.zeros(0)
        self.x = flat.reshape(self.n, d)
        self.id = np.asarray(table["id"].to_numpy(), np.int64)
        if copies:  # of equal vectors only the smallest ids can be among the nearest
            order = np.lexsort((self.id, *self.x.T))
            new = np.append(True, (np.diff(self.x[order], axis=0) != 0).any(1))
            at = np.arange(self.n)
            keep = np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < copies])
            self.x, self.id, self.n = self.x[keep], self.id[keep], len(keep)
            table = table.take(pa.array(keep))
        self.table = table
        self.a, self.b, self.top = measure.sides(self.x)


def same_ids(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(right.id, kind="stable")
    own = right.id[order]
    lo, hi = np.searchsorted(own, left.id, "left"), np.searchsorted(own, left.id, "right")
    n = hi - lo
    i = np.repeat(np.arange(left.n), n)
    return i, order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Cells:
    """A k-d tree of a sample: it places rows, all of them; cells with many equal rows are cut by a hash."""

    def __init__(self, x: np.ndarray, rows: float):
        self.splits: list[tuple] = []
        self.cuts: list[int] = []
        self._grow(x, rows)
        self.first = np.concatenate([[0], np.cumsum(self.cuts)])

    def _grow(self, x: np.ndarray, rows: float) -> int:
        at = len(self.splits)
        self.splits.append(())
        spread = x.max(0) - x.min(0) if len(x) else np.zeros(1)
        if len(x) > rows and spread.max() > 0:
            j = int(spread.argmax())
            cut = float(np.median(x[:, j]))
            if not (x[:, j] < cut).any():
                cut = float(np.min(x[x[:, j] > cut, j]))
            left = x[:, j] < cut
            low, high = self._grow(x[left], rows), self._grow(x[~left], rows)
            self.splits[at] = (j, cut, low, high)
        else:
            self.splits[at] = (len(self.cuts),)
            self.cuts.append(max(1, round(len(x) / rows)))
        return at

    def place(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            node = self.splits[at]
            if len(node) == 1:
                out[rows] = self.first[node[0]] + h[rows] % self.cuts[node[0]]
            else:
                low = x[rows, node[0]] < node[1]
                todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out


def numbered(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(df with whole numbers as ids in the ids' order, (id, n) or None where they are such already)."""
    if isinstance(df.schema["id"].dataType, T.IntegralType):
        return df, None
    names = placed(df.select("id").distinct(), [(F.col("id"), True)]).select(F.col("k0").alias("id"), F.col("before").cast("long").alias("n"))
    names = Store(df.sparkSession).keep(names, "names")
    return df.join(names, "id").drop("id").withColumnRenamed("n", "id"), names


def renamed(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    for c in columns if names is not None else ():
        order = df.columns
        df = df.withColumnRenamed(c, "_n").join(names.toDF("_i", "_n"), "_n").withColumnRenamed("_i", c).select(*order)
    return df


def _open(uri: str):
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


class Blocks:
    """The rows of (id, e, ...) with whole numbers as ids and finite vectors, as blocks; others take no part."""

    def __init__(self, df: DataFrame, metric: str = "euclidean", block_rows: int | None = None):
        self.spark, self.metric = df.sparkSession, metric
        have = F.col("e").isNotNull() & F.col("id").isNotNull()
        df = df.where(have).withColumns({"id": F.col("id").cast("long"), "e": F.col("e").cast("array<double>")})
        n, d = df.agg(F.count("*"), F.coalesce(F.max(F.size("e")), F.lit(0))).first()
        self.d, extra = d, [c for c in df.columns if c not in ("id", "e")]
        cells = None
        if 0 < d <= LOW and metric != "cosine" and n > (rows := block_rows or LEAF):
            step = max(1, n // PLAN)
            sample = df.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(step)) == 0).select("e").collect()  # about PLAN rows at most
            x = np.array([r.e for r in sample if len(r.e) == d], float).reshape(-1, d)
            cells = Cells(x[np.isfinite(x).all(1)], max(1.0, rows * len(x) / n))
        k = int(cells.first[-1]) if cells else max(1, -(-n // (block_rows or min(MOST, max(LEAST, -(-n // BLOCKS))))))
        fields = [f for f in df.schema.fields if f.name in extra]

        def encode(batches):
            for b in batches:
                x = matrix(b)
                if x.shape[1] not in (0, d) and b.num_rows:
                    raise ValueError("vectors differ in length")
                ok = np.isfinite(x).all(1) if x.size else np.zeros(b.num_rows, bool)
                if metric == "cosine":
                    ok &= (x * x).sum(1) > 0
                h = b.column("_h").to_numpy()
                at = cells.place(x, h) if cells else h % k
                data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((np.arange(b.num_rows + 1) * 8 * d).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
                out = pa.table([b.column("id"), data, *(b.column(c) for c in extra), pa.array(at, pa.int64())], ["id", "v", *extra, "_b"])
                yield from out.filter(pa.array(ok)).to_batches()

        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType()), *fields, T.StructField("_b", T.LongType())])
        store = Store(self.spark)
        packed = df.select("id", "e", *extra, F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("_h")).mapInArrow(encode, schema)
        store.keep(packed.repartition(max(1, min(k, 200)), "_b"), "blocks", "uncompressed", "_b")
        path = store._path(f"{store.root}/blocks")
        self.uri = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        self.k = k
        self.measure = Measure(metric, d, np.zeros(d), 1.0)
        self.stats()

    def table(self, j: int) -> pa.Table | None:
        fs, path = _open(self.uri)
        try:
            return pq.read_table(f"{path}/_b={j}", filesystem=fs, partitioning=None)
        except FileNotFoundError:
            return None

    def stats(self) -> None:
        """Rows, bounds and mean of each block, one row a block."""

        def one(j: int):
            t = self.table(j)
            if t is not None and t.num_rows:
                x = Block(t, self.d, Measure(self.metric, LOW, np.zeros(self.d), 1.0)).x
                x = x / np.sqrt((x * x).sum(1))[:, None] if self.metric == "cosine" else x
                lo, hi, mean = (v.tolist() for v in (x.min(0), x.max(0), x.mean(0)))
                yield pa.table({"b": [j], "n": [t.num_rows], "lo": [lo], "hi": [hi], "mean": [mean]})

        rows = self.each(one, "b long, n long, lo array<double>, hi array<double>, mean array<double>").collect()
        shape = (self.k, self.d)
        self.rows, self.lo, self.hi, mean = np.zeros(self.k, np.int64), np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for r in rows:
            self.rows[r.b], self.lo[r.b], self.hi[r.b], mean[r.b] = r.n, r.lo, r.hi, r.mean
        self.n = int(self.rows.sum())
        if not self.n:
            return
        centre = (mean * self.rows[:, None]).sum(0) / self.n
        have = self.rows > 0
        reach = np.maximum(np.abs(self.lo[have] - centre), np.abs(self.hi[have] - centre)).max(0)
        top = float(np.sqrt((reach * reach).sum()))
        self.measure = Measure(self.metric, self.d, centre, 1 / top if np.isfinite(top) and 0 < top < 1e150 else 1.0)

    def bounds(self, own: Blocks, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance that rows of block ``i`` of ``own`` and of each block here can have."""
        if self.measure.product or self.metric == "cosine" or not self.d:
            return np.zeros(self.k), np.full(self.k, np.inf)
        gap = np.maximum(0.0, np.maximum(self.lo - own.hi[i], own.lo[i] - self.hi))
        far = np.maximum(np.abs(self.hi - own.lo[i]), np.abs(own.hi[i] - self.lo))
        f = {"euclidean": lambda v: np.sqrt((v * v).sum(1)), "sqeuclidean": lambda v: (v * v).sum(1), "cityblock": lambda v: v.sum(1), "chebyshev": lambda v: v.max(1)}[self.metric]
        return f(gap) * (1 - SLACK), f(far) * (1 + SLACK)

    def each(self, work, schema: str) -> DataFrame:
        """The tables that ``work(block)`` yields, for each block; neighbouring blocks share a task where they are many."""

        def run(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    for t in work(i):
                        yield from t.to_batches()

        return self.spark.range(0, self.k, 1, min(self.k, 240)).mapInArrow(run, schema)

    def loader(self, measure: Measure | None = None, copies: int = 0):
        """Loads blocks; keeps the last ones where they are small."""
        kept: OrderedDict[int, Block | None] = OrderedDict()
        measure = measure or self.measure

        def load(j: int) -> Block | None:
            if j not in kept:
                t = self.table(j) if self.rows[j] else None
                kept[j] = None if t is None else Block(t, self.d, measure, copies)
                while len(kept) > (KEPT if self.d <= LOW else 1):
                    kept.popitem(last=False)
            kept.move_to_end(j)
            return kept[j]

        return load

    def partners(self, i: int) -> list[int]:
        """Blocks that block ``i`` meets so that each unordered pair of blocks meets once and all have as many."""
        half = [(i + s) % self.k for s in range(self.k // 2 + 1)]
        return half[:-1] if self.k % 2 == 0 and i >= self.k // 2 and self.k > 1 else half

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "spark"}


def tiles(left: Block, right: Block):
    for a in range(0, left.n, TILE):
        for c in range(0, right.n, STRIP):
            yield slice(a, min(a + TILE, left.n)), slice(c, min(c + STRIP, right.n))


def inside(same: tuple[np.ndarray, np.ndarray], rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.searchsorted(same[0], [rows.start, rows.stop])
    i, j = same[0][a:b] - rows.start, same[1][a:b]
    ok = (j >= cols.start) & (j < cols.stop)
    return i[ok], j[ok] - cols.start


def pairs_exact(left: Block, right: Block, i: np.ndarray, j: np.ndarray, metric: str, digits: int | None = None) -> np.ndarray:
    parts = [exact(left.x[i[s : s + 65536]], right.x[j[s : s + 65536]], metric) for s in range(0, len(i), 65536)]
    return away(np.concatenate(parts), digits) if parts else np.zeros(0)


def close(measure: Measure, left: Block, right: Block, rows: slice, cols: slice, radius: float, digits: int | None, same) -> np.ndarray:
    """Which pairs of a tile are others at most the radius apart, those near it by their exact values."""
    g, slack = measure.tile(left, right, rows, cols)
    band = (0.0 if digits is None else 2 * 10.0**-digits) + SLACK * (1 + abs(radius))
    sure, may = measure.at(radius - band), measure.at(radius + band)
    out, maybe = g > float(sure) + slack, g >= float(may) - slack
    maybe ^= out
    at = np.flatnonzero(maybe)
    if len(at):
        i, j = np.divmod(at, g.shape[1])
        out.ravel()[at] = pairs_exact(left, right, rows.start + i, cols.start + j, measure.metric, digits) <= radius
    if len(same[0]):
        out[inside(same, rows, cols)] = False
    return out


def row_counts(mask: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(r) for r in mask], np.int64)
