"""Reports on datasets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.functions.numbers import rounded
from cleaveset.functions.vectors import distance
from cleaveset.operators import embedding, pairwise


def mean_dist(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Mean distance to the centroid, one row."""
    return df.join(F.broadcast(embedding.centroid(df))).agg(rounded(F.avg(distance(F.col("e"), F.col("c"), metric)), 6).alias("mean_dist"))


def compute_centroid(df: DataFrame) -> DataFrame:
    """(pos, value): the centroid by component."""
    return embedding.centroid(df).select(F.posexplode("c").alias("pos", "v")).select("pos", rounded("v", 9).alias("value"))


def split_centroids(df: DataFrame) -> DataFrame:
    """(split, c): the centroid of either side; a side without rows has none."""
    return embedding.centroid(df, ("split",))


def split_similarity(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Distance of the centroids, mean distance of test rows to the nearest train row, and the share of test rows whose
    nearest train row is within the median distance of all pairs. Takes (id, e, split); one row."""
    train, test = (df.where(F.col("split") == s).select("id", "e") for s in ("train", "test"))
    pair = split_centroids(df).groupBy().pivot("split", ["train", "test"]).agg(F.first("c"))
    gap = pair.select(rounded(distance(F.col("train"), F.col("test")), 6).alias("centroid_distance"))
    median = pairwise.pair_quantile(df.select("id", "e"), 0.5, metric)
    near = pairwise.nearest(test, train, metric=metric, digits=6)
    limit = F.lit(None if median is None else round(median, 6)).cast("double")
    sides = near.agg(rounded(F.avg("d"), 6).alias("mean_nearest"), rounded(F.avg((F.col("d") <= limit).cast("double")), 6).alias("coverage"))
    return gap.join(sides)


def kolmogorov_smirnov(df: DataFrame) -> DataFrame:
    """(pos, ks): two-sample statistic of each component of (e, split)."""
    from pyspark.sql import Window

    values = df.select("split", F.posexplode("e").alias("pos", "x")).groupBy("pos", "x").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    upto = Window.partitionBy("pos").orderBy("x")
    every = Window.partitionBy("pos")
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(every) - F.sum("b").over(upto) / F.sum("b").over(every))
    return values.select("pos", gap.alias("gap")).groupBy("pos").agg(rounded(F.max("gap"), 6).alias("ks"))
