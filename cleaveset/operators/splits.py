"""Splitters: each returns (id, split) over (id, e), a disjoint cover of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleaveset.functions.numbers import rounded
from cleaveset.functions.vectors import distance
from cleaveset.operators import cluster as clusters
from cleaveset.operators import embedding, graph, kernels, pairwise
from cleaveset.operators.ranking import cut_by_ratio, cut_groups, fit_or_skip, in_groups, rank_by, shuffle_key, train_size
from cleaveset.store import Store


def by_score(scored: DataFrame, ratio: float = 0.7, low_first: bool = True) -> DataFrame:
    """(id, score, pos, split) of a scored table cut at the ratio."""
    return cut_by_ratio(rank_by(scored, low_first=low_first), ratio).select("id", "score", "pos", "split")


def random_split(df: DataFrame, train_ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """Exactly int(n * ratio) rows of a seeded order in train."""
    hex_key = shuffle_key("id", seed)
    number = F.conv(F.substring(hex_key, 1, 13), 16, 10).cast("double")
    return by_score(df.select("id", number.alias("score")), train_ratio).select("id", "split")


def _whole_clusters(named: DataFrame, train_ratio: float, order: list, sizes: DataFrame | None = None) -> DataFrame:
    named = Store(named.sparkSession).keep(named.select("id", "cluster"), "named")
    sizes = named.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first")) if sizes is None else sizes
    target = train_size(F.sum("n").over(Window.partitionBy(F.lit(0))), train_ratio)
    kept = sizes.withColumn("target", target).where("cluster >= 0")  # one row a cluster
    chosen = fit_or_skip(kept, "cluster", "n", order, F.col("target"))
    return named.join(chosen, "cluster", "left").select("id", F.coalesce("split", F.lit("test")).alias("split"))


def cluster_split(df: DataFrame, train_ratio: float = 0.7, method: str = "kmeans", n_clusters: int = 10, seed: int = 42, cluster: str | None = None, **kwargs) -> DataFrame:
    """Whole clusters, largest first (ties: smallest id), to train while they still fit; noise (-1) is test.

    ``cluster`` names an existing column with integer clusters instead of fitting.
    """
    if cluster:
        named = df.select("id", "e", F.col(cluster).alias("cluster"))
    elif method == "kmeans":
        named, _ = clusters.kmeans(df, n_clusters, seed, **kwargs)
    elif method == "dbscan":
        named = clusters.dbscan(df, **kwargs)
    else:
        raise ValueError(f"Unknown clustering method: {method}")
    return _whole_clusters(named, train_ratio, [(-F.col("n")).alias("_o1"), F.col("first").alias("_o2")])


def centroid_adversarial_split(df: DataFrame, train_ratio: float = 0.7, n_clusters: int = 10, seed: int = 42, cluster: str | None = None, **kwargs) -> DataFrame:
    """Whole clusters, nearest to the global centroid first, to train while they still fit."""
    if cluster:
        named = df.select("id", "e", F.col(cluster).alias("cluster"))
        centers = embedding.centroid(named, ("cluster",)).withColumnRenamed("c", "center")
    else:
        named, centers = clusters.kmeans(df, n_clusters, seed, **kwargs)
    sizes = named.groupBy("cluster").agg(F.count("*").alias("n")).join(centers, "cluster").join(F.broadcast(embedding.centroid(df)))
    sizes = sizes.select("cluster", "n", rounded(distance(F.col("center"), F.col("c")), 6).alias("d"))
    return _whole_clusters(named, train_ratio, [F.col("d").alias("_o1"), F.col("cluster").alias("_o2")], sizes)


def distance_adversarial_split(df: DataFrame, train_ratio: float = 0.7, metric: str = "euclidean") -> DataFrame:
    """The rows nearest to the centroid are train."""
    return by_score(embedding.to_centroid(df, metric), train_ratio)


def density_adversarial_split(df: DataFrame, train_ratio: float = 0.7, metric: str = "euclidean", k: int = 10) -> DataFrame:
    """The densest rows are train."""
    return by_score(embedding.knn_density(df, k, metric), train_ratio, low_first=False)


def outlier_adversarial_split(df: DataFrame, train_ratio: float = 0.7, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """The least isolated rows are train; ``contamination`` is accepted and has no effect on the order."""
    return by_score(embedding.isolation_forest(df, seed=seed), train_ratio)


def min_cut_split(df: DataFrame, train_ratio: float = 0.7, similarity_threshold: float | None = None, metric: str = "euclidean", method: str = "spectral", seed: int = 42) -> DataFrame:
    """Cut of the thresholded similarity graph: along its Fiedler vector, or by Stoer-Wagner."""
    if method == "spectral":
        return by_score(graph.spectral_scores(df, metric, similarity_threshold), train_ratio)
    if method == "stoer_wagner":
        return graph.min_cut_sides(df, train_ratio, similarity_threshold, metric, seed)
    raise ValueError(f"Unknown method: {method}")


def normalized_cut_split(df: DataFrame, train_ratio: float = 0.7, metric: str = "euclidean") -> DataFrame:
    return by_score(graph.spectral_scores(df, metric, thresholded=False, guard=1e-10), train_ratio)


def cluster_leak_split(df: DataFrame, train_ratio: float = 0.7, n_clusters: int = 10, seed: int = 42, cluster: str | None = None, **kwargs) -> DataFrame:
    """Every cluster is split at the ratio in seeded order; a cluster of one goes to test."""
    named = df.select("id", "e", F.col(cluster).alias("cluster")) if cluster else clusters.kmeans(df, n_clusters, seed, **kwargs)[0]
    return cut_groups(named, "cluster", train_ratio, seed=seed).select("id", "split")


def stratified_random_split(df: DataFrame, label: str, train_ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """Per label in seeded order, sizes by largest remainder so that train has int(n * ratio) rows."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))  # one row a label
    short = sizes.where("n < 2").limit(1).count()
    if short:
        raise ValueError("The least populated label has only 1 member")
    share = F.col("n") * F.lit(float(train_ratio))
    everything = Window.partitionBy(F.lit(0))
    quota = sizes.withColumn("base", F.floor(share)).withColumn("rest", rounded(share - F.floor(share), 9))
    quota = quota.withColumn("more", train_size(F.sum("n").over(everything), train_ratio) - F.sum("base").over(everything))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("rest").desc(), label))
    quota = quota.select(F.col(label).alias("_l"), (F.col("base") + F.when(place <= F.col("more"), 1).otherwise(0)).alias("k"))
    order = in_groups(df.select("id", F.col(label).alias("label")), "label", [(shuffle_key("id", seed), True), (F.col("id"), True)])
    return order.select("row.*", "at").join(quota, F.col("label") == F.col("_l")).select("id", F.when(F.col("at") <= F.col("k"), "train").otherwise("test").alias("split"))


def stratified_similarity_split(df: DataFrame, train_ratio: float = 0.7, n_bins: int = 10, seed: int = 42) -> DataFrame:
    """Percentile bins of the distance to the centroid, each split at the ratio with at least one row in train."""
    return cut_groups(embedding.percentile_bins(embedding.to_centroid(df), n_bins), "bin", train_ratio, seed=seed, least=1).select("id", "bin", "split")


def density_balanced_split(df: DataFrame, train_ratio: float = 0.7, n_bins: int = 10, seed: int = 42) -> DataFrame:
    """Percentile bins of the density of 10 neighbours, each split at the ratio with at least one row in train."""
    return cut_groups(embedding.percentile_bins(embedding.knn_density(df), n_bins), "bin", train_ratio, seed=seed, least=1).select("id", "bin", "split")


def duplicate_spread_split(df: DataFrame, train_ratio: float = 0.7, similarity_threshold: float | None = None, metric: str = "euclidean", seed: int = 42, quantile: float = 0.1) -> DataFrame:
    """Components of rows within the threshold have members on both sides; single rows go to train."""
    limit = pairwise.pair_quantile(df, quantile, metric) if similarity_threshold is None else similarity_threshold
    found = graph.components(df.select("id"), pairwise.links(df, -1.0 if limit is None else limit, metric))
    return cut_groups(found, "component", train_ratio, seed=seed, both=True).select("id", "component", "split")


def centroid_matched_split(df: DataFrame, train_ratio: float = 0.7, n_iterations: int = 100, seed: int = 42) -> DataFrame:
    return kernels.run_groups(df, kernels.Centroids(n_iterations), train_ratio, seed)


def distribution_matched_split(df: DataFrame, train_ratio: float = 0.7, n_iterations: int = 1000, seed: int = 42) -> DataFrame:
    return kernels.run_groups(df, kernels.Distribution(n_iterations), train_ratio, seed)


def moment_matched_split(df: DataFrame, train_ratio: float = 0.7, n_iterations: int = 1000, match_variance: bool = True, seed: int = 42) -> DataFrame:
    return kernels.run_groups(df, kernels.Moments(n_iterations, match_variance), train_ratio, seed)


def histogram_matched_split(df: DataFrame, train_ratio: float = 0.7, n_bins: int = 10, n_iterations: int = 1000, seed: int = 42) -> DataFrame:
    return kernels.run_groups(df, kernels.Histograms(n_iterations, n_bins), train_ratio, seed)


def mmd_minimized_split(df: DataFrame, train_ratio: float = 0.7, n_iterations: int = 500, kernel: str = "rbf", gamma: float | None = None, seed: int = 42) -> DataFrame:
    return kernels.run_groups(df, kernels.Discrepancy(n_iterations, kernel, gamma), train_ratio, seed)


def neighbor_coverage_split(df: DataFrame, train_ratio: float = 0.7, k: int = 5, metric: str = "euclidean", seed: int = 42) -> DataFrame:
    return kernels.swap_covered(df, None, metric, train_ratio, seed, k, kernels.neighbor_coverage(k), False)


def nearest_neighbor_split(df: DataFrame, train_ratio: float = 0.7, metric: str = "euclidean", seed: int = 42, pin: bool = False) -> DataFrame:
    return kernels.nearest_neighbor(df, metric, train_ratio, seed, pin)


def max_coverage_split(df: DataFrame, train_ratio: float = 0.7, radius: float | None = None, metric: str = "euclidean", seed: int = 42) -> DataFrame:
    return kernels.swap_covered(df, radius, metric, train_ratio, seed, 1, kernels.max_coverage)


SPLITTERS = {
    "baseline": {"random_split": random_split},
    "adversarial": {f.__name__: f for f in (cluster_split, centroid_adversarial_split, distance_adversarial_split, density_adversarial_split, outlier_adversarial_split, min_cut_split, normalized_cut_split)},
    "overlap": {f.__name__: f for f in (cluster_leak_split, neighbor_coverage_split, centroid_matched_split, stratified_similarity_split, nearest_neighbor_split, duplicate_spread_split, max_coverage_split)},
    "balanced": {f.__name__: f for f in (distribution_matched_split, moment_matched_split, histogram_matched_split, density_balanced_split, mmd_minimized_split)},
}


def get_splitters(category: str | None = None) -> dict:
    """The splitters of a category, the baseline first; all of them without one. Unknown names raise."""
    if category is not None and category not in SPLITTERS:
        raise ValueError(f"Unknown category: {category}")
    names = [category] if category else list(SPLITTERS)
    return {**SPLITTERS["baseline"], **{k: f for n in names for k, f in SPLITTERS[n].items()}}
