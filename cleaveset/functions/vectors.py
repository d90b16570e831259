"""Distances of array<double> columns; the sums run from the first component to the last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "sqeuclidean", "cityblock", "cosine", "chebyshev")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(u, v, lambda a, b: a * b))


def distance(u: Column, v: Column, metric: str = "euclidean") -> Column:
    if metric in ("euclidean", "sqeuclidean"):
        square = _sum(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)))
        return F.sqrt(square) if metric == "euclidean" else square
    if metric == "cityblock":
        return _sum(F.zip_with(u, v, lambda a, b: F.abs(a - b)))
    if metric == "chebyshev":
        return F.array_max(F.zip_with(u, v, lambda a, b: F.abs(a - b)))
    if metric == "cosine":
        return 1 - dot(u, v) / (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)))
    raise ValueError(f"Unknown metric: {metric}")


def dist_euclidean(u: Column, v: Column) -> Column:
    return distance(u, v)
