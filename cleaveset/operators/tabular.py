"""Tabular scorers: each returns (id, score, pos) of a table's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleaveset.functions.numbers import rounded
from cleaveset.operators import embedding
from cleaveset.operators.ranking import average_rank, column as named, quantiles, rank_by

DIGITS = 6


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def text_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in but]


def number(name: str) -> Column:
    return F.when(~F.isnan(named(name).cast("double")), named(name).cast("double"))


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def _ranked(df: DataFrame, id_col: str, score: Column, low_first: bool, digits: int | None = DIGITS) -> DataFrame:
    scored = df.select(named(id_col).alias("id"), (score if digits is None else rounded(score, digits)).alias("score"))
    return rank_by(scored, "score", "id", low_first).select("id", "score", "pos")


def _value(df: DataFrame, column: str) -> Column:
    return named(column) if isinstance(df.schema[column].dataType, T.StringType) else number(column)


def column_value(df: DataFrame, column: str, id_col: str = "id", low_first: bool = True) -> DataFrame:
    """Raw value, nulls last both ways; numbers or strings."""
    return _ranked(df, id_col, _value(df, column), low_first, None)


def column_rank(df: DataFrame, column: str, id_col: str = "id", low_first: bool = True) -> DataFrame:
    """Percentile rank times 100, ties averaged; numbers or strings; nulls are one tied group at the bottom that counts in n."""
    value = df.select(named(id_col).alias("id"), _value(df, column).alias("v"))
    ranks = average_rank(value, "v", "r")
    n = value.count()
    scored = value.join(ranks, F.col("v").eqNullSafe(F.col("_v")))
    return _ranked(scored, "id", F.col("r") / F.lit(n) * 100, low_first)


def column_zscore(df: DataFrame, column: str, id_col: str = "id", low_first: bool = True, absolute: bool = False) -> DataFrame:
    """(v - mean) / sample deviation; a null scores infinity. With no deviation all score 0 in id order."""
    value = df.select(named(id_col).alias("id"), number(column).alias("v"))
    stats = value.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    z = (F.col("v") - F.col("m")) / F.col("s")
    z = F.abs(z) if absolute else z
    score = F.when(F.col("s") == 0, 0.0).when(F.col("v").isNull(), F.lit(float("inf"))).otherwise(rounded(z, DIGITS))
    return _ranked(value.join(F.broadcast(stats)), "id", score, low_first, None)  # one row


def missing_value_ratio(df: DataFrame, id_col: str = "id", low_first: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Nulls (and NaN) over the number of columns."""
    columns = columns or [c for c in df.columns if c != id_col]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    gone = [(named(c).isNull() | (F.isnan(named(c)) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.lit(False))).cast("double") for c in columns]
    return _ranked(df, id_col, total(gone) / len(columns) if columns else F.lit(0.0), low_first)


def row_sparsity(df: DataFrame, id_col: str = "id", threshold: float = 1e-10, low_first: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Share of numeric columns with |v| below the threshold; nulls aren't zero but count in the denominator."""
    columns = columns or numeric_columns(df, (id_col,))
    zero = [F.coalesce((F.abs(number(c)) < threshold).cast("double"), F.lit(0.0)) for c in columns]
    return _ranked(df, id_col, total(zero) / len(columns) if columns else F.lit(0.0), low_first)


def filled(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """(id, x): the numeric columns as an array of doubles, nulls at the column's exact median (0 where all are null)."""
    medians = [quantiles(df, number(c), [0.5])[0] for c in columns]
    return df.select(named(id_col).alias("id"), F.array(*(F.coalesce(number(c), F.lit(float(m or 0.0))) for c, m in zip(columns, medians))).alias("x"))


def outlier_score(df: DataFrame, method: str = "isolation_forest", id_col: str = "id", low_first: bool = True, columns: list[str] | None = None, **kwargs) -> DataFrame:
    """How unusual the median-filled numeric row is, by ``isolation_forest``, ``lof`` or ``zscore``.

    Without numeric columns every row scores 0, whatever the method, as there is nothing to fit.
    """
    columns = columns or numeric_columns(df, (id_col,))
    if not columns:
        return _ranked(df, id_col, F.lit(0.0), low_first)
    if method == "zscore":
        return outlier_zscore(df, id_col, low_first, columns)
    vectors = filled(df, columns, id_col).withColumnRenamed("x", "e")
    return embedding.outlier_score(vectors, method, low_first, **kwargs)


def outlier_zscore(df: DataFrame, id_col: str = "id", low_first: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Mean over numeric columns of |z| with population deviation, nulls at the median; constant columns are skipped."""
    columns = columns or numeric_columns(df, (id_col,))
    if not columns:
        return _ranked(df, id_col, F.lit(0.0), low_first)
    rows, k = filled(df, columns, id_col), range(len(columns))
    stats = rows.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in k), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in k))
    terms = F.filter(F.array(*(F.abs(F.col("x")[i] - F.col(f"m{i}")) / F.nullif(F.col(f"s{i}"), F.lit(0.0)) for i in k)), lambda x: x.isNotNull())
    mean = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(terms), F.lit(0))
    return _ranked(rows.join(F.broadcast(stats)), "id", mean, low_first)  # one row


def numerical_range_score(df: DataFrame, id_col: str = "id", low_first: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Mean over numeric columns of |percentile rank * 100 - 50|; nulls take no rank and are skipped; 0 without such columns."""
    columns = columns or numeric_columns(df, (id_col,))
    if not columns:
        return _ranked(df, id_col, F.lit(0.0), low_first)
    rows = df.select(named(id_col).alias("id"), *(number(c).alias(f"_v{i}") for i, c in enumerate(columns)))
    out = rows
    for i in range(len(columns)):
        have = rows.where(F.col(f"_v{i}").isNotNull())
        ranks = average_rank(have, f"_v{i}", f"_r{i}").withColumnRenamed("_v", f"_k{i}")
        out = out.join(ranks, F.col(f"_v{i}") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    counts = rows.agg(*(F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(columns))))
    terms = F.filter(F.array(*(F.abs(F.col(f"_r{i}") / F.col(f"_n{i}") * 100 - 50) for i in range(len(columns)))), lambda x: x.isNotNull())
    mean = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(terms), F.lit(0))
    return _ranked(out.join(F.broadcast(counts)), "id", mean, low_first)


def _frequency(rows: DataFrame, name: str, out: str) -> DataFrame:
    """Add the value's share of the non-null rows; the counts' own sum is their number."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("c")).agg(F.count("*").alias("k"))
    n = rows.agg(F.count(name)).first()[0]
    return rows.join(counts, F.col(name) == F.col("c"), "left").withColumn(out, F.col("k") / F.lit(n)).drop("c", "k")


def categorical_rarity(df: DataFrame, column: str, id_col: str = "id", low_first: bool = True) -> DataFrame:
    """Relative frequency among non-null rows, null 0; ``low_first`` puts the common values (low rarity) first."""
    rows = df.select(named(id_col).alias("id"), named(column).alias("v"))
    return _ranked(_frequency(rows, "v", "f"), "id", F.coalesce("f", F.lit(0.0)), not low_first)


def feature_entropy(df: DataFrame, id_col: str = "id", low_first: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Sum over text columns of -ln(frequency + 1e-10); a null has frequency 1e-10."""
    columns = columns or text_columns(df, (id_col,))
    rows = df.select(named(id_col).alias("id"), *(named(c).alias(f"v{i}") for i, c in enumerate(columns)))
    for i in range(len(columns)):
        rows = _frequency(rows, f"v{i}", f"f{i}")
    return _ranked(rows, "id", total([-F.log(F.coalesce(F.col(f"f{i}"), F.lit(1e-10)) + 1e-10) for i in range(len(columns))]), low_first)


def row_distance_to_mean(df: DataFrame, id_col: str = "id", low_first: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Euclidean distance of the median-filled numeric row to the mean of the filled rows; 0 without numeric columns."""
    columns = columns or numeric_columns(df, (id_col,))
    if not columns:
        return _ranked(df, id_col, F.lit(0.0), low_first)
    rows, k = filled(df, columns, id_col), range(len(columns))
    means = rows.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in k))
    return _ranked(rows.join(F.broadcast(means)), "id", F.sqrt(total([F.pow(F.col("x")[i] - F.col(f"m{i}"), 2) for i in k])), low_first)  # one row


def multi_column_sort(df: DataFrame, columns: list[str], weights: list[float] | None = None, id_col: str = "id", low_first: bool = True) -> DataFrame:
    """Weighted sum of min-max scaled columns; a constant or all-null column scales to 0.5; a null row has no score."""
    weights = [1.0] * len(columns) if weights is None else weights
    if len(weights) != len(columns):
        raise ValueError("Number of weights must match number of columns")
    rows = df.select(named(id_col).alias("id"), *(number(c).alias(f"v{i}") for i, c in enumerate(columns)))
    ends = rows.agg(*(f(f"v{i}").alias(f"{n}{i}") for i in range(len(columns)) for f, n in ((F.min, "lo"), (F.max, "hi"))))

    def scaled(i: int) -> Column:
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when(F.coalesce(hi > lo, F.lit(False)), (F.col(f"v{i}") - lo) / (hi - lo)).otherwise(0.5)

    return _ranked(rows.join(F.broadcast(ends)), "id", total([w * scaled(i) for i, w in enumerate(weights)]), low_first)  # one row
