"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.llm._store import Store

#: Edges below this number (16 bytes each) are joined on the driver; more take distributed rounds.
ON_DRIVER = 2_000_000


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of their component) of edges a-b, by pointer jumping over minima."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, store: Store, name: str, on_driver: int = ON_DRIVER) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b), both long; the component is the smallest node.

    Up to ``on_driver`` edges are collected, a checked bound. Beyond it, rounds of large-star and small-star contraction
    run on tables in the shared folder until nothing changes.
    """
    spark = edges.sparkSession
    current = store.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    size = current.count()
    if size <= on_driver:
        table = current.toArrow()
        nodes, label = union(table["u"].to_numpy(), table["v"].to_numpy()) if size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return spark.createDataFrame(pa.table([pa.array(nodes, pa.int64()), pa.array(label, pa.int64())], ["node", "component"]))
    turn = 0
    while True:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        turn += 1
        large = store.keep(large, f"{name}-{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        turn += 1
        small = store.keep(small, f"{name}-{turn}")
        left = small.join(current, ["u", "v"], "left_anti").limit(1).count() or current.join(small, ["u", "v"], "left_anti").limit(1).count()
        if not left:
            roots = small.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        current = small
