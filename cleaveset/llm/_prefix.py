"""Running totals within groups in hash order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hexadecimal digest; monotone in the digest."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def before(df: DataFrame, groups: list[str], key: str, order: list[str], value: str, out: str, stats: DataFrame, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows of the same group that come earlier by (key, order).

    ``stats`` has the groups, which aren't null, with ``group_rows``. A group is cut into buckets of about ``rows_per_bucket`` rows by
    ranges of its uniform hexadecimal ``key``, so a group with a third of all rows becomes many small sorts. Bucket
    totals are summed per group; only they, one row a bucket, meet in one task.
    """
    buckets = F.greatest(F.lit(1.0), F.ceil(F.col("group_rows") / rows_per_bucket))
    cut = df.join(stats, groups).withColumn("_bucket", F.floor(unit(F.col(key)) * buckets)).drop("group_rows")
    own = groups
    totals = cut.groupBy(*own, "_bucket").agg(F.sum(value).alias("_total"))
    totals = totals.select(*own, "_bucket", (F.sum("_total").over(Window.partitionBy(*own).orderBy("_bucket")) - F.col("_total")).alias("_base"))
    inner = Window.partitionBy(*own, "_bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.join(totals, [*own, "_bucket"]).select("*", (F.col("_base") + F.sum(value).over(inner) - F.col(value)).alias(out))
    return placed.drop("_bucket", "_base")
