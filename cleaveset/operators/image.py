"""Image scorers over (id, height, width, data): 8-bit pixels in B, G, R order as Spark's image source gives them.

Brightness, contrast and colour variance also work on a pixel relation (id, y, x, r, g, b), in expressions only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleaveset.functions.numbers import rounded
from cleaveset.operators.ranking import rank_by

DIGITS = 6


def gray(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of the usual weights."""
    return F.floor((r * 299 + g * 587 + b * 114) / 1000)


def _ranked(scored: DataFrame, low_first: bool) -> DataFrame:
    return rank_by(scored.select("id", rounded("score", DIGITS).alias("score")), low_first=low_first).select("id", "score", "pos")


def mean_brightness(pixels: DataFrame, low_first: bool = True) -> DataFrame:
    return _ranked(pixels.groupBy("id").agg(F.avg(gray(F.col("r"), F.col("g"), F.col("b"))).alias("score")), low_first)


def contrast(pixels: DataFrame, low_first: bool = True) -> DataFrame:
    return _ranked(pixels.groupBy("id").agg(F.stddev_pop(gray(F.col("r"), F.col("g"), F.col("b"))).alias("score")), low_first)


def color_variance(pixels: DataFrame, low_first: bool = True) -> DataFrame:
    """Variance over the three channels of a pixel, averaged."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    m = (r + g + b) / 3
    return _ranked(pixels.groupBy("id").agg(F.avg(((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 3).alias("score")), low_first)


def to_pixels(images: DataFrame) -> DataFrame:
    """The pixel relation of (id, height, width, data)."""
    kind = images.schema["id"].dataType.simpleString()

    def run(found):
        for pdf in found:
            for i, h, w, data in zip(pdf.id, pdf.height, pdf.width, pdf["data"]):
                a = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(np.int32)
                y, x = np.mgrid[0:h, 0:w]
                yield pd.DataFrame({"id": i, "y": y.ravel(), "x": x.ravel(), "r": a[..., 2].ravel(), "g": a[..., 1].ravel(), "b": a[..., 0].ravel()})

    return images.select("id", "height", "width", "data").mapInPandas(run, f"id {kind}, y int, x int, r int, g int, b int")


def _luma(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int64)
    return (a[..., 2] * 299 + a[..., 1] * 587 + a[..., 0] * 114) // 1000


def _scored(images: DataFrame, score) -> DataFrame:
    @F.pandas_udf("double")
    def run(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([score(np.frombuffer(d, np.uint8).reshape(h, w, 3)) for h, w, d in zip(height, width, data)], dtype="float64")

    return images.select("id", run("height", "width", "data").alias("score"))


def frequency_share(image: np.ndarray) -> float:
    """Share of the 2-D Fourier magnitude outside radius min(h, w) // 8 of the centre."""
    g = _luma(image).astype(float)
    m = np.abs(np.fft.fftshift(np.fft.fft2(g)))
    h, w = g.shape
    y, x = np.ogrid[:h, :w]
    low = np.sqrt((x - w // 2) ** 2 + (y - h // 2) ** 2) <= min(h, w) // 8
    total = m.sum()
    return float(m[~low].sum() / total) if total else 0.0


def frequency_content(images: DataFrame, low_first: bool = True) -> DataFrame:
    return _ranked(_scored(images, frequency_share), low_first)


def zlib_ratio(images: DataFrame, low_first: bool = True, level: int = 6) -> DataFrame:
    """Raw over deflated bytes: the substitute for a JPEG ratio where no codec is installed."""
    return _ranked(_scored(images, lambda a: a.size / max(1, len(zlib.compress(a.tobytes(), level)))), low_first)


def dominant_rgb(image: np.ndarray, n_clusters: int, seed: int, most: int) -> np.ndarray:
    """Centre of the largest of the k-means clusters of the pixels."""
    rng = np.random.RandomState(seed)
    x = image.reshape(-1, 3)[:, ::-1].astype(float)
    if len(x) > most:
        x = x[rng.choice(len(x), most, replace=False)]
    distinct, n = np.unique(x, axis=0, return_counts=True)
    k = min(n_clusters, len(distinct))
    centers = [distinct[n.argmax()]]
    while len(centers) < k:  # farthest-point start
        d = np.min([((distinct - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(distinct[d.argmax()])
    c = np.array(centers)
    for _ in range(50):
        label = ((distinct[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([np.average(distinct[label == j], axis=0, weights=n[label == j]) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c[np.bincount(label, n, k).argmax()]


def dominant_color(images: DataFrame, n_clusters: int = 5, target_color=(128, 128, 128), low_first: bool = True, seed: int = 42, most: int = 10_000) -> DataFrame:
    """(id, score, pos, rgb): distance of the dominant colour to the target; images over ``most`` pixels are sampled."""
    kind = images.schema["id"].dataType.simpleString()

    def run(found):
        for pdf in found:
            rows = [(i, dominant_rgb(np.frombuffer(d, np.uint8).reshape(h, w, 3), n_clusters, seed, most)) for i, h, w, d in zip(pdf.id, pdf.height, pdf.width, pdf["data"])]
            yield pd.DataFrame({"id": [i for i, _ in rows], "score": [float(np.linalg.norm(c - np.array(target_color))) for _, c in rows], "rgb": [[int(v) for v in c] for _, c in rows]})

    scored = images.select("id", "height", "width", "data").mapInPandas(run, f"id {kind}, score double, rgb array<int>")
    return rank_by(scored.withColumn("score", rounded("score", DIGITS)), low_first=low_first).select("id", "score", "pos", "rgb")
