"""Bounded samples of labelled rows, the same for every partitioning and however often a row is repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups whose counts are broadcast: one short row each.
FEW = 10_000


def unit(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":fit"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def hash_sample(df: DataFrame, by: str, groups: int, most: int, value: str, tie: Column) -> DataFrame:
    """(by, i, value, rank): at most ``most`` rows of each of the ``groups`` values of ``by``, those with the smallest hashes of ``i``.

    ``df`` has (by, i, value); ``tie`` is a short digest of the value. Rows that agree in all three are one, so a row
    repeated a million times takes one place and never meets itself in one task: a cut by hash range, from distinct
    counts, leaves a few times ``most`` rows of each ``by``, repeats are merged where they lie, and only the rest is
    ranked.
    """
    counts = df.groupBy(by).agg(F.approx_count_distinct("i", 0.02).alias("n"))
    near = df.join(F.broadcast(counts) if groups <= FEW else counts, by).withColumn("u", unit(F.col("i"))).where(F.col("u") * F.col("n") < 4.0 * most + 40)
    one = near.withColumn("tie", tie).groupBy(by, "i", "u", "tie").agg(F.min(value).alias(value))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("u", "i", "tie"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select(by, "i", value, "rank")
