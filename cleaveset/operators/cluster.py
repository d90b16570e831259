"""Clusterings and cluster reports over (id, e)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleaveset.functions.numbers import rounded
from cleaveset.operators import pairwise
from cleaveset.operators.graph import components
from cleaveset.store import Store


def kmeans(df: DataFrame, n_clusters: int = 10, seed: int = 42, **kwargs) -> tuple[DataFrame, DataFrame]:
    """((id, e, cluster), (cluster, center)): MLlib k-means; clusters are renumbered by their smallest id."""
    data = df.select("id", "e", array_to_vector("e").alias("features"))
    model = KMeans(k=n_clusters, seed=seed, **kwargs).fit(data)
    found = model.transform(data).select("id", "e", F.col("prediction").alias("_p"))
    first = found.groupBy("_p").agg(F.min("id").alias("_i"))
    number = first.select("_p", (F.row_number().over(Window.orderBy("_i")) - 1).cast("int").alias("cluster"))  # one row a cluster
    centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "_p int, center array<double>")
    return found.join(F.broadcast(number), "_p").drop("_p"), number.join(F.broadcast(centers), "_p").drop("_p")


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """(id, e, cluster): density clusters numbered by smallest core id, -1 for noise.

    Core rows have ``min_samples`` rows within ``eps``, themselves included; clusters are components of core-core edges;
    a border row joins the cluster of its smallest-numbered core neighbour. Pairs are counted, linked and searched by
    blocks and never rows.
    """
    rows = df.select("id", "e")
    counts = Store(df.sparkSession).keep(rows.join(pairwise.within(rows, eps, metric), "id", "left").withColumn("core", F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id", "e", "core"), "counts")
    core = counts.where("core").select("id", "e")
    found = Store(df.sparkSession).keep(components(core, pairwise.links(core, eps, metric)).withColumnRenamed("component", "root"), "roots")
    roots = found.select("root").distinct()
    number = roots.select("root", (F.row_number().over(Window.orderBy("root")) - 1).cast("int").alias("cluster"))  # one row a cluster
    named = Store(df.sparkSession).keep(found.join(number, "root").select("id", "cluster"), "named")
    border = pairwise.least_near(counts.where(~F.col("core")).select("id", "e"), core.join(named, "id"), eps, "cluster", metric)
    border = border.select("id", F.col("cluster").cast("int").alias("border"))
    return df.join(named, "id", "left").join(border, "id", "left").select("id", "e", F.coalesce("cluster", "border", F.lit(-1)).alias("cluster"))


def cluster_info(df: DataFrame, cluster: str = "cluster", split: str = "split") -> DataFrame:
    """Per cluster: total, in_train, in_test, leakage (the smaller side) and whether it leaks; with the ratio of all."""
    one = df.groupBy(cluster).agg(F.count("*").alias("total"), F.count_if(F.col(split) == "train").alias("in_train"), F.count_if(F.col(split) == "test").alias("in_test"))
    one = one.withColumn("leakage", F.least("in_train", "in_test"))
    ratio = one.agg((F.count_if(F.col("leakage") > 0) / F.count("*")).alias("leak_ratio"))
    return one.join(F.broadcast(ratio)).select(cluster, "total", "in_train", "in_test", "leakage", rounded("leak_ratio", 6).alias("leak_ratio"))
