"""Seeded synthetic tables: 2-D point clouds, images and sounds.

Points are closed forms over spark.range with hashed uniforms, so a row depends on its id and the seed alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleaveset.operators.audio import SR


def _u(name: str, seed: int) -> Column:
    """Uniform in (0, 1) by id, name and seed: the first 52 bits of a digest that any SQL engine has."""
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{name}:{seed}")))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _normal(name: str, seed: int) -> Column:
    return F.sqrt(-2 * F.log(_u(name + "r", seed))) * F.cos(2 * math.pi * _u(name + "a", seed))


def _points(spark: SparkSession, n: int, x: Column, y: Column) -> DataFrame:
    return spark.range(n).select("id", F.array(x, y).alias("e"))


def make_unimodal(spark, n=500, seed=42):
    return _points(spark, n, _normal("x", seed), _normal("y", seed))


def make_bimodal(spark, n=500, seed=42):
    side = F.when(F.col("id") < n // 2, -3.0).otherwise(3.0)
    return _points(spark, n, side + _normal("x", seed) * 0.8, _normal("y", seed) * 0.8)


def make_multimodal(spark, n=500, blobs=5, seed=42):
    n -= n % blobs
    turn = 2 * math.pi * (F.col("id") % blobs) / blobs
    return _points(spark, n, 5 * F.cos(turn) + _normal("x", seed) * 0.5, 5 * F.sin(turn) + _normal("y", seed) * 0.5)


def make_concentric_rings(spark, n=600, rings=3, seed=42):
    n -= n % rings
    r = 2.0 * (F.col("id") % rings + 1) + _normal("r", seed) * 0.15
    a = 2 * math.pi * _u("a", seed)
    return _points(spark, n, r * F.cos(a), r * F.sin(a))


def make_moons(spark, n=500, noise=0.1, seed=42):
    t = math.pi * _u("t", seed)
    upper = F.col("id") % 2 == 0
    x = F.when(upper, F.cos(t)).otherwise(1 - F.cos(t))
    y = F.when(upper, F.sin(t)).otherwise(0.5 - F.sin(t))
    return _points(spark, n, x + _normal("x", seed) * noise, y + _normal("y", seed) * noise)


def make_spiral(spark, n=500, turns=2.0, seed=42):
    t = F.sqrt(_u("t", seed)) * turns * 2 * math.pi
    side = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    return _points(spark, n, side * t * F.cos(t) / 3 + _normal("x", seed) * 0.1, side * t * F.sin(t) / 3 + _normal("y", seed) * 0.1)


def make_anisotropic(spark, n=500, seed=42):
    a, b = _normal("x", seed), _normal("y", seed)
    return _points(spark, n, 2 * a + 1.5 * b, 1.5 * a + 1.2 * b)


def make_uniform_square(spark, n=500, seed=42):
    return _points(spark, n, 4 * _u("x", seed) - 2, 4 * _u("y", seed) - 2)


def make_density_gradient(spark, n=500, seed=42):
    return _points(spark, n, -F.log(_u("x", seed)) * 2, _normal("y", seed))


def make_clustered_outliers(spark, n=500, share=0.05, seed=42):
    far = F.col("id") >= int(n * (1 - share))
    return _points(spark, n, F.when(far, 8 + _normal("x", seed) * 0.3).otherwise(_normal("x", seed)), F.when(far, 8 + _normal("y", seed) * 0.3).otherwise(_normal("y", seed)))


DISTRIBUTIONS = {f.__name__[5:]: f for f in (make_unimodal, make_bimodal, make_multimodal, make_concentric_rings, make_moons, make_spiral, make_anisotropic, make_uniform_square, make_density_gradient, make_clustered_outliers)}


def get_distributions(name: str | None = None) -> dict:
    if name is not None and name not in DISTRIBUTIONS:
        raise ValueError(f"Unknown distribution: {name}")
    return {name: DISTRIBUTIONS[name]} if name else dict(DISTRIBUTIONS)


def split_grid(spark: SparkSession, distributions: dict, splitters: dict, n: int = 500) -> DataFrame:
    """(dist, method, id, x, y, split) of every splitter on every distribution: the table behind a grid of plots."""
    parts = []
    for name, make in distributions.items():
        points = make(spark, n)
        for method, split in splitters.items():
            parts.append(points.join(split(points), "id").select(F.lit(name).alias("dist"), F.lit(method).alias("method"), "id", F.col("e")[0].alias("x"), F.col("e")[1].alias("y"), "split"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def named_images(seed: int = 0) -> dict[str, np.ndarray]:
    """The fifteen named 50 x 50 RGB fixtures."""
    rng = np.random.RandomState(seed)
    y, x = np.mgrid[0:50, 0:50]
    flat = lambda *c: np.full((50, 50, 3), c, np.uint8)
    same = lambda g: np.repeat(np.clip(g, 0, 255).astype(np.uint8)[..., None], 3, 2)
    check = lambda k: (x // k + y // k) % 2 * 255
    return {
        "dark": flat(30, 30, 30), "medium": flat(128, 128, 128), "bright": flat(230, 230, 230),
        "low_contrast": same(rng.normal(128, 10, (50, 50))), "high_contrast": same(check(5)),
        "grayscale": same(rng.randint(0, 256, (50, 50))), "vibrant": np.stack([5 * y % 256, 5 * x % 256, 3 * (x + y) % 256], 2).astype(np.uint8),
        "red": flat(200, 50, 50), "green": flat(50, 200, 50), "blue": flat(50, 50, 200),
        "simple": flat(100, 150, 200), "complex": rng.randint(0, 256, (50, 50, 3)).astype(np.uint8),
        "smooth": same(x * 255 / 49), "medium_detail": same(check(10)), "detailed": same(check(1)),
    }


def image_table(spark: SparkSession, seed: int = 0) -> DataFrame:
    rows = [(k, *a.shape[:2], bytearray(a[..., ::-1].tobytes())) for k, a in named_images(seed).items()]
    return spark.createDataFrame(rows, "id string, height int, width int, data binary")


def named_sounds(sr: int = SR, seed: int = 0) -> dict[str, np.ndarray]:
    """Named one- and two-second signals, not normalised, so loudness differs between them."""
    rng = np.random.RandomState(seed)
    t, t2 = np.arange(sr) / sr, np.arange(2 * sr) / sr
    sine = lambda f, a=0.5, at=t: a * np.sin(2 * np.pi * f * at)
    noise = lambda a=0.5: a * rng.uniform(-1, 1, sr)

    def clicks(every: float) -> np.ndarray:
        out = np.zeros(2 * sr)
        for s in np.arange(0, 2, every):
            k = int(s * sr)
            out[k : k + 200] = np.exp(-np.arange(200) / 40)[: len(out) - k]
        return out

    return {
        "quiet": sine(440, 0.1), "medium": sine(440, 0.5), "loud": sine(440, 1.0),
        "low_dynamics": sine(440, 0.5) + 0.3, "high_dynamics": sine(440, 0.9) * (0.5 + 0.5 * np.sin(4 * np.pi * t)),
        "dark": sine(100), "mid": sine(1000), "bright": sine(4000), "tonal": sine(440), "noisy": noise(), "narrow": sine(440), "wide": noise(),
        "low_zcr": sine(50), "high_zcr": sine(8000) + noise(0.1), "low_pitch": sine(100), "high_pitch": sine(1000),
        "stable": sine(440), "chirp": 0.5 * np.sin(2 * np.pi * (200 * t + 900 * t * t)), "slow": clicks(1.0), "fast": clicks(1 / 3),
        "strong_beats": clicks(0.5), "weak_beats": sine(440, 0.3, t2), "harmonic": sine(220, 0.4) + sine(440, 0.2) + sine(660, 0.1),
        "percussive": noise() * (np.sin(2 * np.pi * 4 * t) > 0.95), "compressible": sine(440), "incompressible": noise(),
    }


def sound_table(spark: SparkSession, sr: int = SR, seed: int = 0) -> DataFrame:
    return spark.createDataFrame([(k, sr, [float(v) for v in y]) for k, y in named_sounds(sr, seed).items()], "id string, sr int, y array<double>")


def formula_images(spark: SparkSession, n: int = 20) -> DataFrame:
    """(id, height, width, data): n images of 50 x 50 pixels by a closed form that SQL can repeat."""

    def run(found):
        y, x = np.mgrid[0:50, 0:50]
        for pdf in found:
            data = [np.stack([(x * y + i) % 256, (y * 5 + i * i) % 256, (x * 5 + i * 7) % 256], 2).astype(np.uint8).tobytes() for i in pdf.id]
            yield pd.DataFrame({"id": pdf.id, "height": 50, "width": 50, "data": data})

    return spark.range(n).mapInPandas(run, "id long, height int, width int, data binary")


def formula_sounds(spark: SparkSession, n: int = 4, length: int = 2048) -> DataFrame:
    """(id, sr, y): n sounds by a closed form, each a tone with more noise than the one before."""
    t = F.sequence(F.lit(0), F.lit(length - 1))

    def sample(k: Column) -> Column:
        noise = ((k * k * 7919 + (F.col("id") + 1) * k * 104729) % 1000) / 1000 - 0.5
        return 0.5 * F.sin(2 * math.pi * 200 * (F.col("id") + 1) * k / SR) + 0.1 * F.col("id") * noise

    return spark.range(n).select("id", F.lit(SR).alias("sr"), F.transform(t, lambda k: sample(k.cast("long"))).alias("y"))
