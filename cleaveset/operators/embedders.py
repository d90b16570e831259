"""Embedders: plug-in points that turn a column into (id, e), and dimension reduction."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.functions.text import simple_tokenizer


class Embedder(Protocol):
    """Anything that maps a table to (id, e)."""

    def transform(self, df: DataFrame) -> DataFrame: ...


class ModelEmbedder:
    """An injected model: ``load()`` runs once in each worker and returns a function from a list of inputs to vectors.

    Sentence transformers, CLIP towers and remote embedding services all fit; a missing library fails in ``load``.
    """

    def __init__(self, load, column: str, id_col: str = "id"):
        self.load, self.column, self.id_col = load, column, id_col

    def transform(self, df: DataFrame) -> DataFrame:
        load = self.load

        def run(found):
            embed = load()
            for values in found:
                yield pd.Series([[float(x) for x in v] for v in embed(list(values))])

        return df.select(F.col(self.id_col).alias("id"), _iterator(run)(F.col(self.column)).alias("e"))


def _iterator(run):
    from collections.abc import Iterator

    def typed(found: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(found)

    typed.__annotations__ = {"found": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(typed, "array<double>")


class HashingEmbedder:
    """Hashed token counts scaled to unit length: the offline substitute for a text model."""

    def __init__(self, column: str = "text", id_col: str = "id", dims: int = 64):
        self.column, self.id_col, self.dims = column, id_col, dims

    def transform(self, df: DataFrame) -> DataFrame:
        tokens = df.select(F.col(self.id_col).alias("id"), simple_tokenizer(F.lower(F.coalesce(F.col(self.column), F.lit("")))).alias("_t"))
        counts = HashingTF(numFeatures=self.dims, inputCol="_t", outputCol="_v").transform(tokens).select("id", vector_to_array("_v").alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        return counts.select("id", F.transform("v", lambda x: F.coalesce(x / F.nullif(norm, F.lit(0.0)), F.lit(0.0))).alias("e"))


def _pca(df: DataFrame, n_components: int) -> DataFrame:
    data = df.select("id", array_to_vector("e").alias("v"))
    return PCA(k=n_components, inputCol="v", outputCol="p").fit(data).transform(data).select("id", vector_to_array("p").alias("e"))


def _needs(library: str):
    def run(df: DataFrame, n_components: int, **kwargs) -> DataFrame:
        __import__(library)
        import numpy as np

        kind = df.schema["id"].dataType.simpleString()

        def project(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.array(pdf.e.tolist())
            if library == "umap":
                import umap

                y = umap.UMAP(n_components=n_components, **kwargs).fit_transform(x)
            else:
                from sklearn.manifold import TSNE

                y = TSNE(n_components=n_components, **kwargs).fit_transform(x)
            return pd.DataFrame({"id": pdf.id, "e": [list(map(float, r)) for r in y]})

        return df.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(project, f"id {kind}, e array<double>")

    return run


REDUCERS = {"umap": _needs("umap"), "tsne": _needs("sklearn"), "pca": lambda df, n_components: _pca(df, n_components)}


def reduce(df: DataFrame, method: str = "umap", n_components: int = 2, **kwargs) -> DataFrame:
    """(id, e) with fewer dimensions. umap and tsne need their libraries; pca is the built-in substitute."""
    if method not in REDUCERS:
        raise ValueError(f"Unknown method: {method}")
    return REDUCERS[method](df, n_components, **kwargs)
