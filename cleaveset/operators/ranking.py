"""Ranking and cutting: distributed positions in a total order, ratio cuts, per-group cuts and the fit-or-skip fold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleaveset.store import Store

#: Rows of one range of a total order; more rows take more ranges.
ROWS = 250_000
#: monotonically_increasing_id numbers the rows of a partition in its lower bits.
BITS = 33


def clean(score: Column) -> Column:
    """NaN counts as no score."""
    return F.when(~F.isnan(score), score)


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def placed(df: DataFrame, keys: list[tuple[Column, bool]], weight: Column | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """(row, k0, k1, ..., before): each row as a struct with its keys and what comes before it in their order.

    ``keys`` are (expression, ascending), nulls last either way. ``before`` is the number of earlier rows, or the sum of
    their ``weight``. Rows are computed once, into a table. Up to ROWS of them are one sort; more are cut into ranges of
    the whole key, ties by the later keys included, so neither equal scores nor equal beginnings of texts meet in one
    task. A row's place in its sorted range is its number there, and only the ranges' totals are summed together.
    """
    store = Store(df.sparkSession)
    names = [f"k{i}" for i in range(len(keys))]
    own = F.struct(*(column(c) for c in df.columns if c not in without)) if set(df.columns) - set(without) else F.struct(F.lit(0))
    packed = df.select(own.alias("row"), *(e.alias(n) for (e, _), n in zip(keys, names)), *([] if weight is None else [weight.alias("w")]))
    table = store.keep(packed, "scored")
    order = [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, (_, up) in zip(names, keys)]
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    n = table.count()
    if n <= ROWS:
        one = Window.orderBy(*order)
        return table.select("row", *names, (F.row_number().over(one) - 1 if weight is None else F.coalesce(F.sum("w").over(upto(one)), F.lit(0))).alias("before"))
    ranged = table.repartitionByRange(-(-n // ROWS), *order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    ranged = store.keep(ranged, "ranged").withColumn("b", F.shiftright("m", BITS))
    store.drop("scored")
    totals = ranged.groupBy("b").agg((F.count("*") if weight is None else F.sum("w")).alias("t"))
    base = totals.select("b", (F.sum("t").over(Window.orderBy("b")) - F.col("t")).alias("base"))  # one row a range
    inside = F.col("m").bitwiseAND(F.lit((1 << BITS) - 1)) if weight is None else F.coalesce(F.sum("w").over(upto(Window.partitionBy("b").orderBy("m"))), F.lit(0))
    return ranged.join(base, "b").select("row", *names, (F.col("base") + inside).alias("before"))


def with_before(df: DataFrame, score: str, id_col: str, low_first: bool = True, weight: Column | None = None, out: str = "_before") -> DataFrame:
    """Add the sum of ``weight`` (rows by default) over the rows that come earlier by (score, id); no score comes last."""
    return placed(df, [(column(score), low_first), (column(id_col), True)], weight, (out,)).select("row.*", F.col("before").alias(out))


def rank_by(df: DataFrame, score: str = "score", id_col: str = "id", low_first: bool = True) -> DataFrame:
    """Add ``pos`` from 1 in the order of (score, id ascending); rows without a score come last either way."""
    return placed(df, [(column(score), low_first), (column(id_col), True)], without=("pos",)).select("row.*", (F.col("before") + 1).cast("long").alias("pos"))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """(_v, out): average rank of each distinct value, those without one as a last tied group."""
    rows = placed(df.select(column(value).alias("v")), [(F.col("v"), True)])
    return rows.groupBy(F.col("k0").alias("_v")).agg((F.min("before") + (F.count("*") + 1) / 2).alias(out))


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Exact linearly interpolated quantiles of the values that aren't null, by their places in the order."""
    rows = placed(df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull()), [(F.col("v"), True)])
    n = rows.count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    need = sorted({int(a) for a in at} | {min(int(a) + 1, n - 1) for a in at})
    have = {r.before: r.k0 for r in rows.where(F.col("before").isin(need)).select("before", "k0").collect()}  # two for each share
    return [have[int(a)] + (have[min(int(a) + 1, n - 1)] - have[int(a)]) * (a - int(a)) for a in at]


def train_size(n: Column, ratio: float) -> Column:
    """int(n * ratio): a double product, truncated."""
    return F.floor(n.cast("double") * F.lit(float(ratio))).cast("long")


def cut_by_ratio(ranked: DataFrame, ratio: float = 0.7, pos: str = "pos") -> DataFrame:
    """Add ``split``: the first int(n * ratio) positions are train."""
    n = ranked.agg(F.count("*").alias("n")).first().n
    return ranked.withColumn("split", F.when(column(pos) <= train_size(F.lit(n), ratio), "train").otherwise("test"))


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    """A seeded order that depends on ids only: the same for every partitioning and in any SQL engine."""
    return F.md5(F.concat(column(id_col).cast("string"), F.lit(f":{seed}")))


def in_groups(df: DataFrame, group: str, order: list[tuple[Column, bool]]) -> DataFrame:
    """(row, at, n): the place of a row in its group from 1, and the group's size.

    Groups are runs of one total order, so a group with a third of all rows is many ranges.
    """
    rows = placed(df, [(column(group), True), *order])
    sizes = rows.groupBy("k0").agg(F.min("before").alias("first"), F.count("*").alias("n"))
    joined = rows.join(sizes.withColumnRenamed("k0", "g"), F.col("k0").eqNullSafe(F.col("g")))
    return joined.select("row", (F.col("before") - F.col("first") + 1).cast("long").alias("at"), "n")


def cut_groups(df: DataFrame, group: str, ratio: float, id_col: str = "id", seed: int = 42, least: int = 0, both: bool = False) -> DataFrame:
    """Split each group at int(size * ratio) of its seeded order, with at least ``least`` in train.

    ``both`` keeps one row on either side of groups of two and more; groups of one go to train.
    """
    k = F.greatest(F.lit(least), train_size(F.col("n"), ratio))
    if both:
        k = F.when(F.col("n") == 1, 1).otherwise(F.least(F.greatest(k, F.lit(1)), F.col("n") - 1))
    return in_groups(df, group, [(shuffle_key(id_col, seed), True), (column(id_col), True)]).select("row.*", F.when(F.col("at") <= k, "train").otherwise("test").alias("split"))


def fit_or_skip(clusters: DataFrame, cluster: str, size: str, order: list[Column], target: Column) -> DataFrame:
    """(cluster, split): whole clusters to train in ``order`` while they still fit into ``target``; others are skipped.

    The fold is sequential by definition: one task takes a cluster's number, size and order, no rows.
    """
    kind = clusters.schema[cluster].dataType.simpleString()
    names = [f"o{i}" for i in range(len(order))]
    rows = clusters.select(column(cluster).alias("c"), column(size).cast("long").alias("n"), target.cast("long").alias("t"), *(o.alias(n) for o, n in zip(order, names)), F.lit(0).alias("g"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([(n, "ascending") for n in [*names, "c"]])
        left = table["t"][0].as_py() if table.num_rows else 0
        split = []
        for n in table["n"].to_pylist():
            split.append("train" if n <= left else "test")
            left -= n if n <= left else 0
        return pa.table({"c": table["c"], "split": pa.array(split, pa.string())})

    return rows.groupBy("g").applyInArrow(fold, f"c {kind}, split string").select(F.col("c").alias(cluster), "split")
