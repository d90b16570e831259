"""Embedding scorers over (id, e): each returns (id, score, pos)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.functions.numbers import rounded
from cleaveset.functions.vectors import distance
from cleaveset.operators import pairwise
from cleaveset.operators.ranking import in_groups, quantiles, rank_by
from cleaveset.store import Store

DIGITS = 6


def centroid(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., c): the mean vector, by partial sums of components."""
    parts = df.select(*by, F.posexplode("e").alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return parts.groupBy(*by).agg(listed.alias("c"))


def to_centroid(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(id, score): rounded distance to the centroid."""
    return df.join(F.broadcast(centroid(df))).select("id", rounded(distance(F.col("e"), F.col("c"), metric), DIGITS).alias("score"))


def distance_to_mean(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    return rank_by(to_centroid(df, metric)).select("id", "score", "pos")


def distance_to_nearest_neighbor(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Distance to the nearest other row; infinity for a single row."""
    near = pairwise.nearest(df, metric=metric, digits=DIGITS).select("id", "d")
    return rank_by(df.select("id").join(near, "id", "left").select("id", F.coalesce("d", F.lit(float("inf"))).alias("score"))).select("id", "score", "pos")


def local_density(df: DataFrame, radius: float | None = None, metric: str = "euclidean", low_first: bool = True) -> DataFrame:
    """How many others lie within the radius (default: median distance of all pairs); sparse first."""
    if radius is None:
        radius = pairwise.pair_quantile(df, 0.5, metric)
        radius = 0.0 if radius is None else round(radius, DIGITS)
    counts = pairwise.within(df, radius, metric, DIGITS)
    return rank_by(df.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("score")), low_first=low_first).select("id", "score", "pos")


def lof(df: DataFrame, k: int = 20, metric: str = "euclidean") -> DataFrame:
    """(id, score): local outlier factor; the neighbours of a row are exactly k, ties by id."""
    near = pairwise.nearest(df, k=k, metric=metric, digits=9)
    last = near.groupBy("id").agg(F.max("d").alias("kd"))
    reach = near.join(last.select(F.col("id").alias("other"), "kd"), "other").withColumn("r", F.greatest("d", "kd"))
    density = reach.groupBy("id").agg((1 / (F.avg("r") + 1e-10)).alias("lrd"))
    others = density.select(F.col("id").alias("other"), F.col("lrd").alias("olrd"))
    return near.select("id", "other").join(others, "other").groupBy("id").agg(F.avg("olrd").alias("m")).join(density, "id").select("id", rounded(F.col("m") / F.col("lrd"), DIGITS).alias("score"))


def average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng: np.random.RandomState):
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth >= limit or len(x) <= 1 or not len(spread):
        return (len(x),)
    j = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
    left = x[:, j] < cut
    return (j, cut, _grow(x[left], depth + 1, limit, rng), _grow(x[~left], depth + 1, limit, rng))


def _paths(tree, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + average_path(tree[0]))
    j, cut, low, high = tree
    out = np.empty(len(x))
    left = x[:, j] < cut
    out[left], out[~left] = _paths(low, x[left], depth + 1), _paths(high, x[~left], depth + 1)
    return out


def isolation_forest(df: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(id, score): 2 ** (-E[path] / c(sample)), higher for outliers.

    Trees grow on the driver from a seeded sample of at most trees * sample rows, which is the algorithm's own bound;
    all rows are scored.
    """
    n = df.count()
    if not n:
        return df.select("id", F.lit(0.0).alias("score"))
    size = min(sample, n)
    pool_rows = min(n, trees * size)
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":forest:{seed}")))
    near = df.withColumn("_k", key).where(F.conv(F.substring("_k", 1, 8), 16, 10).cast("double") / 2**32 <= min(1.0, 1.3 * pool_rows / n + 200 / n))
    pool = np.array([r.e for r in near.orderBy("_k", "id").limit(pool_rows).select("e").collect()])
    rng = np.random.RandomState(seed)
    limit = math.ceil(math.log2(max(size, 2)))
    forest = df.sparkSession.sparkContext.broadcast([_grow(pool[rng.permutation(len(pool))[:size]], 0, limit, rng) for _ in range(trees)])
    scale = max(average_path(size), 1e-12)

    @F.pandas_udf("double")
    def score(e: pd.Series) -> pd.Series:
        x = np.array(e.tolist())
        return pd.Series(2 ** (-np.mean([_paths(t, x) for t in forest.value], axis=0) / scale) if len(x) else [], dtype="float64")

    return df.select("id", rounded(score("e"), 9).alias("score"))


def outlier_score(df: DataFrame, method: str = "isolation_forest", low_first: bool = True, **kwargs) -> DataFrame:
    if method == "isolation_forest":
        scored = isolation_forest(df, **kwargs)
    elif method == "lof":
        scored = lof(df, **kwargs)
    else:
        raise ValueError(f"Unknown outlier detection method: {method}")
    return rank_by(scored, low_first=low_first).select("id", "score", "pos")


def knn_density(df: DataFrame, k: int = 10, metric: str = "euclidean") -> DataFrame:
    """(id, score): 1 / (mean distance to the k nearest others + 1e-10)."""
    means = pairwise.nearest(df, k=k, metric=metric, digits=9).groupBy("id").agg((1 / (F.avg("d") + 1e-10)).alias("s"))
    return df.select("id").join(means, "id", "left").select("id", rounded(F.coalesce("s", F.lit(1e10)), DIGITS).alias("score"))


def percentile_bins(scored: DataFrame, n_bins: int) -> DataFrame:
    """Add ``bin``: how many of the inner exact percentile edges are at most the score."""
    scored = Store(scored.sparkSession).keep(scored, "scored")
    edges = [round(x, DIGITS) for x in quantiles(scored, F.col("score"), [i / n_bins for i in range(1, n_bins)]) if x is not None]
    edges = F.array(*(F.lit(float(x)) for x in edges)) if edges else F.array().cast("array<double>")
    return scored.withColumn("bin", F.size(F.filter(edges, lambda x: x <= F.col("score"))))


def per_label_order(df: DataFrame, label: str) -> DataFrame:
    """(id, label, score, pos, n): distance to the own label's centroid and place within the label."""
    own = df.select("id", "e", F.col(label).alias("label"))
    scored = own.join(centroid(own, ("label",)), "label").select("id", "label", rounded(distance(F.col("e"), F.col("c")), DIGITS).alias("score"))
    return in_groups(scored, "label", [(F.col("score"), True), (F.col("id"), True)]).select("row.*", F.col("at").alias("pos"), "n")
