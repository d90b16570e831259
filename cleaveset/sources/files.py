"""Readers of text lines, images and WAV audio, and writers of image and audio files."""

from __future__ import annotations

import io
import struct
import wave
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleaveset.operators.audio import SR


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): stripped lines that aren't blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    return lines.where("line <> ''")


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, height, width, data) of the files that decode, pixels in B, G, R order; one-channel images are repeated."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)

    @F.pandas_udf("binary")
    def three(channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([bytes(d) if c == 3 else (np.repeat(np.frombuffer(d, np.uint8), 3) if c == 1 else np.frombuffer(d, np.uint8).reshape(-1, c)[:, :3]).tobytes() for c, d in zip(channels, data)])

    return found.select(F.col("image.origin").alias("id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), three("image.nChannels", "image.data").alias("data"))


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(content)) as f:
        width, channels = f.getsampwidth(), f.getnchannels()
        raw = f.readframes(f.getnframes())
        if width == 1:
            y = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
        elif width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            y = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
        else:
            y = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << 8 * width - 1)
        return f.getframerate(), y.reshape(-1, channels).mean(1)


def audio(spark: SparkSession, path: str, sr: int | None = SR) -> DataFrame:
    """(id, sr, y) of WAV files, channels averaged and resampled linearly to ``sr`` (None keeps the file's rate)."""

    def run(found):
        for pdf in found:
            out = []
            for p, content in zip(pdf.path, pdf.content):
                rate, y = decode_wav(content)
                if sr and rate != sr and len(y):
                    n = int(np.ceil(len(y) * sr / rate))
                    rate, y = sr, np.interp(np.arange(n) * rate / sr, np.arange(len(y)), y)
                out.append((p, rate, y.astype(np.float32)))
            yield pd.DataFrame(out, columns=["id", "sr", "y"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "id string, sr int, y array<float>")


def samples(audios: DataFrame) -> DataFrame:
    """The sample relation (id, t, y) of (id, sr, y)."""
    return audios.select("id", F.posexplode("y").alias("t", "y")).withColumn("y", F.col("y").cast("double"))


def write_png(path: str, rgb: np.ndarray) -> None:
    """An 8-bit RGB image as PNG."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def write_wav(path: str, y: np.ndarray, sr: int = SR, peak: float | None = None) -> None:
    """16-bit mono WAV; ``peak`` scales the loudest sample to it."""
    if peak and np.abs(y).max() > 0:
        y = y / np.abs(y).max() * peak
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(sr)
        f.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
