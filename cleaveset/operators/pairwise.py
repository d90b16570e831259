"""Pairwise distances by sweeps over blocks (see ``blocks``), reduced inside the tasks.

Pairs never become rows unless they are asked for (``edges``, ``pairwise_distances``). Memory of a task is bounded by two
blocks and a tile, what is shuffled by the rows; the work is quadratic, as the operators' definitions are, but for few
components, where bounds of the blocks leave neighbouring ones. Decisions that hang on rounding are made on distances
computed component by component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleaveset.functions.vectors import METRICS
from cleaveset.operators.blocks import SLACK, TILE, Blocks, away, close, exact, inside, matrix, numbered, pairs_exact, renamed, row_counts, same_ids, tiles
from cleaveset.store import Store

#: Rows of a block of ``pairwise_distances``.
BLOCK_ROWS = 2048
#: Squared distances below this share of the squared lengths lose digits in matrix products and are computed again.
SMALL = 1e-3
#: Rows whose distances lead the search for a quantile, and how far around its place there the search begins.
LEAD, AROUND = 3000, 0.02
BINS = 1 << 16


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two small matrices, to about 12 digits."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (a @ b.T) / np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
    if metric in ("euclidean", "sqeuclidean"):
        size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
        out = size - 2 * (a @ b.T)
        i, j = np.nonzero(out < SMALL * size)
        for k in range(0, len(i), 1 << 16):
            u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            out[u, v] = exact(a[u], b[v], "sqeuclidean")
        return np.sqrt(out) if metric == "euclidean" else out
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        step = np.abs(a[:, j, None] - b[None, :, j])
        if metric == "cityblock":
            out += step
        elif metric == "chebyshev":
            np.maximum(out, step, out=out)
        else:
            raise ValueError(f"Unknown metric: {metric}")
    return out


def block_pairs(left: DataFrame, right: DataFrame, reduce, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Apply ``reduce(left table, right table)`` to each pair of a left and a right block of (id, e) rows."""
    a, b = max(1, -(-left.count() // block_rows)), max(1, -(-right.count() // block_rows))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select(*(F.col(c).alias(c) for c in left.columns))
    x = left.select("*", own(a).alias("_i"), every(b).alias("_j"))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    y = right.select("*", every(a).alias("_i"), own(b).alias("_j"))

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        return reduce(p, q)

    return x.groupBy("_i", "_j").cogroup(y.groupBy("_i", "_j")).applyInArrow(run, schema)


def numbers(p: pa.Table, q: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of two tables as whole numbers in the ids' order."""
    if pa.types.is_integer(p.schema.field("id").type) and pa.types.is_integer(q.schema.field("id").type):
        return np.array(p["id"].to_numpy(), np.int64), np.array(q["id"].to_numpy(), np.int64)
    code, _ = pd.factorize(np.array(p["id"].to_pylist() + q["id"].to_pylist(), object), sort=True)
    return code[: p.num_rows].astype(np.int64), code[p.num_rows :].astype(np.int64)


def _tiles(p: pa.Table, q: pa.Table, metric: str):
    """(rows of the left block, distances, ids differ) by tiles of the left block, with both matrices and id numbers."""
    if not p.num_rows or not q.num_rows:
        return
    x, y = matrix(p), matrix(q)
    u, v = numbers(p, q)
    for a in range(0, len(x), TILE):
        at = np.arange(a, min(a + TILE, len(x)))
        yield at, distances(x[at], y, metric), u[at, None] != v[None, :], x, y, u, v


def _checked(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")


def _whole(left: DataFrame, right: DataFrame | None = None):
    """Both tables with whole numbers as ids, and those numbers' ids where they aren't the ids themselves."""
    if right is None:
        left, names = numbered(left)
        return left, None, names
    both = [isinstance(x.schema["id"].dataType, T.IntegralType) for x in (left, right)]
    if all(both):
        return left, right, None
    _, names = numbered(left.select("id").union(right.select("id")))
    own = lambda x: x.join(names, "id").drop("id").withColumnRenamed("n", "id")
    return own(left), own(right), names


def _back(df: DataFrame, names: DataFrame | None, kinds: dict[str, str], name: str) -> DataFrame:
    """Computed once, into a table, with the ids' own type."""
    df = Store(df.sparkSession).keep(df, name)
    return renamed(df, names, *kinds) if names is not None else df.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def nearest(left: DataFrame, right: DataFrame | None = None, k: int = 1, metric: str = "euclidean", digits: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(id, other, d, place): the k nearest rows of ``right`` (default: the other rows of ``left``), ties by id.

    A task has the k nearest so far of its block's rows; a tile gives those that may be nearer once rounded, and their
    exact distances place them. Blocks come by their least distance, until none can hold a nearer row.
    """
    _checked(metric)
    kinds = {"id": left.schema["id"].dataType.simpleString(), "other": (left if right is None else right).schema["id"].dataType.simpleString()}
    left, right, names = _whole(left, right)
    own = Blocks(left.select("id", "e"), metric, block_rows)
    other = own if right is None else Blocks(right.select("id", "e"), metric, block_rows)
    if own.n and other.n and own.d != other.d:
        raise ValueError("vectors differ in length")
    same, measure = right is None, other.measure
    band = 2 * 10.0**-digits if digits is not None else 0.0
    none = np.iinfo(np.int64).max

    def work(i: int):
        take = own.loader(measure)
        block = take(i)
        if block is None or not other.n:
            return
        load = other.loader(measure, k + 1 if not measure.product and metric != "cosine" else 0)
        d, ids = np.full((block.n, k), np.inf), np.full((block.n, k), none)
        least, _ = other.bounds(own, i)
        for j in sorted(np.flatnonzero(other.rows), key=lambda j: (least[j], (j - i) % other.k)):
            if least[j] > (worst := d[:, -1].max()) + band + SLACK * (1 + worst):
                break
            there = load(int(j))
            pairs = same_ids(block, there) if same else (np.zeros(0, np.int64),) * 2
            for rows, cols in tiles(block, there):
                g, slack = measure.tile(block, there, rows, cols)
                if len(pairs[0]):
                    g[inside(pairs, rows, cols)] = -np.inf
                last = d[rows, -1]
                least_g = measure.at(last + band + SLACK * (1 + np.abs(last))) - slack
                if (new := np.flatnonzero(np.isinf(last))).size:
                    m = min(k, g.shape[1])
                    kth = np.partition(np.where(np.isnan(g[new]), -np.inf, g[new]), g.shape[1] - m, axis=1)[:, g.shape[1] - m].astype(float)
                    reach = np.array([measure.distance(v - slack) if np.isfinite(v) else np.inf for v in kth])
                    least_g[new] = np.where(np.isfinite(kth), measure.at(reach + band + SLACK * (1 + np.abs(reach))) - slack, -np.inf)
                a, b = np.divmod(np.flatnonzero(g >= least_g.astype(g.dtype)[:, None]), g.shape[1])
                if same and len(pairs[0]) and len(a):
                    ok = block.id[rows.start + a] != there.id[cols.start + b]
                    a, b = a[ok], b[ok]
                if not len(a):
                    continue
                e = pairs_exact(block, there, rows.start + a, cols.start + b, metric, digits)
                ok = np.isfinite(e)
                a, e, n = a[ok] + rows.start, e[ok], there.id[cols.start + b[ok]]
                u = np.unique(a)
                r, e, n = np.concatenate([np.repeat(u, k), a]), np.concatenate([d[u].ravel(), e]), np.concatenate([ids[u].ravel(), n])
                order = np.lexsort((n, e, r))
                r, e, n = r[order], e[order], n[order]
                first = np.searchsorted(r, u)
                top = first[:, None] + np.arange(k)
                d[u], ids[u] = e[top], n[top]
        a, b = np.nonzero(np.isfinite(d))
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            yield pa.table([block.id[x], ids[x, y], d[x, y], (y + 1).astype(np.int32)], ["id", "other", "d", "place"])

    return _back(own.each(work, "id long, other long, d double, place int"), names, kinds, "nearest")


def within(left: DataFrame, radius: float, metric: str = "euclidean", digits: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(id, n): how many other rows are at most ``radius`` away."""
    _checked(metric)
    kind = left.schema["id"].dataType.simpleString()
    left, _, names = _whole(left)
    own = Blocks(left.select("id", "e"), metric, block_rows)
    found = _back(counted(own, own, radius, digits), names, {"id": kind}, "within")
    return found.groupBy("id").agg(F.sum("n").alias("n"))  # one row, unless an id repeats


def counted(own: Blocks, other: Blocks, radius: float, digits: int | None = None, total: str | None = None) -> DataFrame:
    """(id, n) or, with the column to sum, (id, n, s): the rows of ``other`` with another id that are within the radius."""
    measure, band = other.measure, (0.0 if digits is None else 2 * 10.0**-digits) + SLACK * (1 + abs(radius))

    def work(i: int):
        block = own.loader(measure)(i)
        if block is None:
            return
        load = other.loader()
        n, s = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
        least, most = other.bounds(own, i)
        for j in np.flatnonzero((other.rows > 0) & (least <= radius + band)):
            there = load(int(j))
            pairs = same_ids(block, there)
            values = there.table[total].to_numpy().astype(float) if total else None
            if most[j] < radius - band:
                n += there.n - np.bincount(pairs[0], minlength=block.n)
                if total:
                    s += (values.sum() - np.bincount(pairs[0], values[pairs[1]], minlength=block.n)).astype(np.int64)
                continue
            for rows, cols in tiles(block, there):
                near = close(measure, block, there, rows, cols, radius, digits, pairs)
                n[rows] += row_counts(near)
                if total:
                    s[rows] += (near @ values[cols]).astype(np.int64)
        yield pa.table([block.id, n, *([s] if total else [])], ["id", "n", *(["s"] if total else [])])

    return own.each(work, "id long, n long" + ", s long" * bool(total))


def edges(left: DataFrame, radius: float, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """(a, b, d): pairs a < b at most ``radius`` apart; as many rows as there are such pairs."""
    _checked(metric)
    kind = left.schema["id"].dataType.simpleString()
    left, _, names = _whole(left)
    own = Blocks(left.select("id", "e"), metric, block_rows)
    measure = own.measure

    def work(i: int):
        load = own.loader()
        block = own.loader()(i)
        least, _ = own.bounds(own, i)
        for j in np.flatnonzero((own.rows > 0) & (least <= radius + SLACK * (1 + abs(radius)))) if block else ():
            there = load(int(j))
            pairs = same_ids(block, there)
            for rows, cols in tiles(block, there):
                a, b = np.nonzero(close(measure, block, there, rows, cols, radius, None, pairs))
                a, b = a + rows.start, b + cols.start
                ok = block.id[a] < there.id[b]
                a, b = a[ok], b[ok]
                yield pa.table([block.id[a], there.id[b], pairs_exact(block, there, a, b, metric)], ["a", "b", "d"])

    return _back(own.each(work, "a long, b long, d double"), names, {"a": kind, "b": kind}, "edges")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each of n nodes' components over the links (a, b)."""
    at = np.arange(n)
    while len(a):
        x, y = at[a], at[b]
        low = np.minimum(x, y)
        np.minimum.at(at, x, low)
        np.minimum.at(at, y, low)
        while (at[at] != at).any():
            at = at[at]
        keep = at[a] != at[b]
        a, b = a[keep], b[keep]
    return at


def tile_links(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of links that join what the marks of a tile join: all of them, or a spanning forest if they are many."""
    if np.count_nonzero(near) <= 4 * sum(near.shape):
        return np.nonzero(near)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    todo, free = near.any(1), np.ones(near.shape[1], bool)
    while todo.any():
        rows = np.array([todo.argmax()])
        todo[rows] = False
        while len(rows):
            part = near[rows]
            cols = np.flatnonzero(part.any(0) & free)
            if not len(cols):
                break
            free[cols] = False
            links.append((rows[part[:, cols].argmax(0)], cols))
            part = near[:, cols]
            rows = np.flatnonzero(part.any(1) & todo)
            todo[rows] = False
            links.append((rows, cols[part[rows].argmax(1)]))
    return tuple(np.concatenate(z) for z in zip(*links)) if links else (np.zeros(0, np.int64),) * 2


def links(left: DataFrame, radius: float, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """(a, b): pairs with the same components as all pairs at most ``radius`` apart.

    A block returns at most one link for each row that it meets, however many pairs are that near.
    """
    _checked(metric)
    kind = left.schema["id"].dataType.simpleString()
    left, _, names = _whole(left)
    own = Blocks(left.select("id", "e"), metric, block_rows)
    measure, wide = own.measure, radius + SLACK * (1 + abs(radius))

    def work(i: int):
        block = own.loader()(i)
        if block is None:
            return
        load = own.loader()
        root = np.arange(block.n)
        least, _ = own.bounds(own, i)
        for j in own.partners(i):
            if not own.rows[j] or least[j] > wide:
                continue
            there = load(j)
            pairs, base = same_ids(block, there), 0 if j == i else block.n
            a, b = [np.arange(block.n)], [root]
            for rows, cols in tiles(block, there):
                u, v = tile_links(close(measure, block, there, rows, cols, radius, None, pairs))
                a.append(u + rows.start)
                b.append(v + cols.start + base)
            at = roots(block.n + there.n, np.concatenate(a), np.concatenate(b))
            root = at[: block.n]
            if j != i:
                other = at[block.n :]
                hit = np.flatnonzero(other < block.n)
                if len(hit):
                    yield pa.table([block.id[other[hit]], there.id[hit]], ["a", "b"])
        tied = np.flatnonzero(root != np.arange(block.n))
        yield pa.table([block.id[root[tied]], block.id[tied]], ["a", "b"])

    return _back(own.each(work, "a long, b long"), names, {"a": kind, "b": kind}, "links")


def least_near(left: DataFrame, right: DataFrame, radius: float, value: str, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """(id, value): the least whole ``value`` of the rows of ``right`` at most ``radius`` from a row of ``left``."""
    _checked(metric)
    kind = left.schema["id"].dataType.simpleString()
    left, right, names = _whole(left, right)
    own, other = Blocks(left.select("id", "e"), metric, block_rows), Blocks(right.select("id", "e", F.col(value).cast("long").alias("value")), metric, block_rows)
    measure, none = other.measure, np.iinfo(np.int64).max

    def work(i: int):
        block = own.loader(measure)(i)
        if block is None or not other.n:
            return
        load = other.loader()
        least, _ = other.bounds(own, i)
        best = np.full(block.n, none)
        for j in np.flatnonzero((other.rows > 0) & (least <= radius + SLACK * (1 + abs(radius)))):
            there = load(int(j))
            pairs, values = same_ids(block, there), there.table["value"].to_numpy()
            for rows, cols in tiles(block, there):
                a, b = np.nonzero(close(measure, block, there, rows, cols, radius, None, pairs))
                np.minimum.at(best, a + rows.start, values[b + cols.start])
        at = np.flatnonzero(best < none)
        yield pa.table([block.id[at], best[at]], ["id", value])

    return _back(own.each(work, f"id long, {value} long"), names, {"id": kind}, "least")


def pairwise_distances(df: DataFrame, metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, d) of all ordered pairs, self-pairs included: quadratic output, for small tables."""
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    kind = df.schema["id"].dataType.simpleString()

    def reduce(p: pa.Table, q: pa.Table) -> pa.Table:
        ds = [d.ravel() for _, d, *_ in _tiles(p, q, metric)]
        i, j = np.repeat(np.arange(p.num_rows), q.num_rows), np.tile(np.arange(q.num_rows), p.num_rows)
        return pa.table([p["id"].take(pa.array(i)), q["id"].take(pa.array(j)), pa.array(np.concatenate(ds) if ds else [], pa.float64())], ["a", "b", "d"])

    return block_pairs(df, df, reduce, f"a {kind}, b {kind}, d double", block_rows)


def pair_quantile(df: DataFrame, q: float, metric: str = "euclidean", positive: bool = False, block_rows: int | None = None, most: int = 500_000) -> float | None:
    """Exact linearly interpolated quantile of the distances of ordered pairs of different rows; ``positive`` leaves zeros out."""
    found = pair_places(df, lambda n: [q * (n - 1)], metric, positive, block_rows, most)
    if found is None:
        return None
    a, b, share = found[0]
    return float(a + (b - a) * share)


def pair_places(df: DataFrame, at, metric: str = "euclidean", positive: bool = False, block_rows: int | None = None, most: int = 500_000) -> list[tuple[float, float, float]] | None:
    """(value below, value above, share of the way) at each place, from 0, that ``at(number of ordered pairs)`` gives.

    Distances of some rows say about where to look. One pass over all pairs counts them in bins there by their products;
    a second one counts exactly those below the bin of the place, widened by the products' error, and returns its exact
    distances. Those are narrowed until few are left to be sorted. Where the place is elsewhere, bins cover all distances.
    """
    _checked(metric)
    df, _, _ = _whole(df.select("id", "e"))
    own = Blocks(df, metric, block_rows)
    if own.n < 2:
        return None
    measure = own.measure
    lead = df.where(F.col("e").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(1, own.n // LEAD))) == 0)).select("e").collect()  # about LEAD rows
    x = np.array([r.e for r in lead], float).reshape(len(lead), -1)
    d = np.concatenate([distances(x[i : i + 1], x[i + 1 :], metric).ravel() for i in range(len(x) - 1)]) if len(x) > 1 else np.zeros(0)
    d = np.sort(d[np.isfinite(d) & (d > 0 if positive else True)])
    ends = [float(measure.at(0.0)), float(measure.at(2.0 if metric == "cosine" else _width(own)))]
    pad = 1e-3 * (1 + abs(ends[1]))
    whole = ends[1] - pad, ends[0] + pad
    if len(d) > 1:
        shares = [p / max(1, own.n * (own.n - 1) - 1) for p in at(own.n * (own.n - 1))]
        near, far = (d[min(len(d) - 1, max(0, int(s * len(d))))] for s in (min(shares) - AROUND, max(shares) + AROUND))
        low = whole[0] if max(shares) + AROUND >= 1 else float(measure.at(far * (1 + SLACK)))
        high = whole[1] if min(shares) - AROUND <= 0 else float(measure.at(near * (1 - SLACK)))
    else:
        low, high = whole

    def each_tile(i: int):
        block = own.loader()(i)
        load = own.loader()
        for j in own.partners(i) if block else ():
            if own.rows[j]:
                there = load(j)
                pairs = same_ids(block, there)
                for rows, cols in tiles(block, there):
                    yield block, there, rows, cols, inside(pairs, rows, cols), 1 if i == j else 2

    def histogram(i: int, low: float, high: float):
        total, above, zeros, error, scale = np.zeros(BINS, np.int64), 0, 0, 0.0, BINS / (high - low)
        every = 0
        for block, there, rows, cols, same, weight in each_tile(i):
            g, slack = measure.tile(block, there, rows, cols)
            error = max(error, slack)
            g[same] = np.nan
            every += weight * (g.size - len(same[0]))
            if not measure.product:
                every -= weight * (int(np.isnan(g).sum()) - len(same[0]))
            if positive:
                a, b = np.nonzero(g >= float(measure.at(SLACK)) - slack - SLACK)
                zeros += weight * int((pairs_exact(block, there, rows.start + a, cols.start + b, metric) <= 0).sum())
            over = g > high
            above += weight * np.count_nonzero(over)
            over |= g < low
            np.logical_not(over, out=over)
            found = g.ravel()[np.flatnonzero(over)]
            found = found[~np.isnan(found)].astype(float)
            total += weight * np.bincount(np.minimum(((found - low) * scale).astype(np.int64), BINS - 1), minlength=BINS)
        bins = np.flatnonzero(total)
        yield pa.table({"b": bins, "n": total[bins], "error": np.zeros(len(bins))})
        yield pa.table({"b": np.array([-1, -2, -3]), "n": np.array([above, zeros, every], np.int64), "error": np.array([error, 0.0, 0.0])})

    while True:
        found = own.each(lambda i, low=low, high=high: histogram(i, low, high), "b long, n long, error double")
        counts, error = {}, 0.0
        for r in found.groupBy("b").agg(F.sum("n").alias("n"), F.max("error").alias("error")).collect():  # at most BINS rows and three
            counts[r.b], error = r.n, max(error, r.error)
        above, zeros, every = (counts.pop(b, 0) for b in (-1, -2, -3))
        first = zeros if positive else 0
        if every - first <= 0:
            return None
        wanted = at(every - first)
        places = sorted({first + int(f(p)) for p in wanted for f in (np.floor, np.ceil)})
        bins = np.array(sorted(counts, reverse=True), np.int64)  # the nearest first
        upto = above + np.cumsum([counts[b] for b in bins])
        if len(bins) and places[0] >= above and places[-1] < upto[-1] or (low, high) == whole:
            break
        low, high = whole
    step = (high - low) / BINS
    edge = lambda p: bins[min(int(np.searchsorted(upto, p, "right")), len(bins) - 1)] if len(bins) else 0
    top = np.inf if not len(bins) or places[0] < above else low + (edge(places[0]) + 1) * step + error + 1e-9 * step
    bottom = -np.inf if not len(bins) or places[-1] >= upto[-1] else low + edge(places[-1]) * step - error - 1e-9 * step
    lo = 0.0 if np.isinf(top) else max(0.0, measure.distance(top)) * (1 - SLACK) if metric != "cosine" else measure.distance(top) - SLACK
    lo = -np.inf if np.isinf(top) or (lo <= 0 and metric != "cosine") else lo
    hi = np.inf if np.isinf(bottom) else measure.distance(bottom) * (1 + SLACK) + SLACK * (metric == "cosine")

    def collect(i: int):
        below, parts, held = 0, [], 0
        sure = float(measure.at(lo - SLACK * (1 + abs(lo)))) if np.isfinite(lo) else np.inf
        may = float(measure.at(hi + SLACK * (1 + abs(hi)))) if np.isfinite(hi) else -np.inf

        def values():
            v, n = np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts])
            v, back = np.unique(v, return_inverse=True)
            return v, np.bincount(back, n, len(v)).astype(np.int64)

        for block, there, rows, cols, same, weight in each_tile(i):
            g, slack = measure.tile(block, there, rows, cols)
            g[same] = np.nan
            over = g > sure + slack
            below += weight * np.count_nonzero(over)
            maybe = g >= may - slack
            maybe ^= over
            at = np.flatnonzero(maybe)
            if len(at):
                a, b = np.divmod(at, g.shape[1])
                e = pairs_exact(block, there, rows.start + a, cols.start + b, metric)
                below += weight * int((e < lo).sum())
                e = e[(e >= lo) & (e <= hi)]
                parts.append((e, np.full(len(e), weight)))
                held += len(e)
                if held > 1 << 20:
                    parts[:] = [values()]
                    held = len(parts[0][0])
                    if held > 1 << 19:
                        yield pa.table({"v": parts[0][0], "n": parts[0][1]})
                        parts, held = [], 0
        if parts:
            v, n = values()
            yield pa.table({"v": v, "n": n})
        yield pa.table({"v": pa.array([None], pa.float64()), "n": [below]})

    band = Store(df.sparkSession).keep(own.each(collect, "v double, n long"), "band")
    below = band.where("v IS NULL").agg(F.sum("n")).first()[0] or 0
    band = band.where("v IS NOT NULL")
    while band.count() > most:  # narrowed by bins of the values until few are left
        low, high = band.agg(F.min("v"), F.max("v")).first()
        if not high > low:
            break
        number = F.least(F.lit(BINS - 1), F.floor((F.col("v") - low) / (high - low) * BINS)).cast("long")
        rows = sorted(band.groupBy(number.alias("b")).agg(F.sum("n").alias("n")).collect())
        upto = below + np.cumsum([r.n for r in rows])
        one, two = (rows[int(np.searchsorted(upto, p, "right"))].b for p in (places[0], places[-1]))
        if two - one >= BINS - 1:
            break
        below += sum(r.n for r in rows if r.b < one)
        band = band.where((number >= one) & (number <= two))
    rows = sorted(band.groupBy("v").agg(F.sum("n").alias("n")).collect())
    v, upto = np.array([r.v for r in rows]), below + np.cumsum([r.n for r in rows])
    have = {p: float(v[min(int(np.searchsorted(upto, p, "right")), len(v) - 1)]) for p in places}
    return [(have[first + int(np.floor(p))], have[first + int(np.ceil(p))], float(p - np.floor(p))) for p in wanted]


def _width(own: Blocks) -> float:
    """No two rows are further apart than this, but for rounding."""
    have = own.rows > 0
    far = own.hi[have].max(0) - own.lo[have].min(0)
    return float({"euclidean": np.sqrt((far * far).sum()), "sqeuclidean": (far * far).sum(), "cityblock": far.sum(), "chebyshev": far.max(initial=0.0)}[own.metric])
