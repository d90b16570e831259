"""Row-local scores on streams, and ranked cuts of micro-batches.

Length, diversity, sparsity and distance to a fixed centroid need one row only, so they run on an unbounded table as on
a bounded one. Positions and cuts need a whole set: they are taken in each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleaveset.functions import text as fn
from cleaveset.functions.vectors import distance
from cleaveset.operators.ranking import cut_by_ratio, rank_by


def row_score(stream: DataFrame, score: Column, id_col: str = "id") -> DataFrame:
    return stream.select(F.col(id_col).alias("id"), score.alias("score"))


def lexical_diversity(text_col: str = "text") -> Column:
    tokens = fn.simple_tokenizer(F.col(text_col))
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)


def distance_to(centroid: list[float], vec_col: str = "e", metric: str = "euclidean") -> Column:
    return distance(F.col(vec_col).cast("array<double>"), F.array(*(F.lit(float(x)) for x in centroid)), metric)


def windowed_mean(stream: DataFrame, time_col: str, value: Column, width: str = "10 minutes", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean score in event-time windows; rows later than ``late`` are left out and the state of closed windows is freed."""
    windows = stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), *by).agg(F.avg(value).alias("score"), F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), *by, "score", "n")


def split_batches(sink: Callable[[DataFrame, int], None], ratio: float = 0.7, low_first: bool = True) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rank (id, score) within the micro-batch, cut it at the ratio and hand it on."""

    def run(batch: DataFrame, number: int) -> None:
        sink(cut_by_ratio(rank_by(batch, low_first=low_first), ratio), number)

    return run
