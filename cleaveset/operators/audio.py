"""Audio scorers. Amplitude measures work on a sample relation (id, t, y) in expressions; spectral ones on (id, sr, y)
with y an array, in numpy over frames of 2,048 samples every 512, centred."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleaveset.functions.numbers import rounded
from cleaveset.operators.ranking import rank_by

DIGITS = 6
N_FFT, HOP, SR = 2048, 512, 22050


def _ranked(scored: DataFrame, low_first: bool) -> DataFrame:
    return rank_by(scored.select("id", rounded("score", DIGITS).alias("score")), low_first=low_first).select("id", "score", "pos")


def mean_amplitude(samples: DataFrame, low_first: bool = True) -> DataFrame:
    return _ranked(samples.groupBy("id").agg(F.avg(F.abs("y")).alias("score")), low_first)


def rms_energy(samples: DataFrame, low_first: bool = True) -> DataFrame:
    return _ranked(samples.groupBy("id").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("score")), low_first)


def dynamic_range(samples: DataFrame, low_first: bool = True) -> DataFrame:
    return _ranked(samples.groupBy("id").agg((F.max(F.abs("y")) - F.min(F.abs("y"))).alias("score")), low_first)


def peak_to_average_ratio(samples: DataFrame, low_first: bool = True) -> DataFrame:
    return _ranked(samples.groupBy("id").agg(F.coalesce(F.max(F.abs("y")) / F.nullif(F.avg(F.abs("y")), F.lit(0.0)), F.lit(0.0)).alias("score")), low_first)


def zero_crossings(samples: DataFrame, low_first: bool = True) -> DataFrame:
    """Sign changes over samples of the whole signal; zero counts as positive."""
    sign = F.when(F.col("y") < 0, 1).otherwise(0)
    before = F.lag(sign).over(Window.partitionBy("id").orderBy("t"))
    flips = samples.select("id", (sign != before).cast("double").alias("x"))
    return _ranked(flips.groupBy("id").agg((F.coalesce(F.sum("x"), F.lit(0.0)) / F.count("*")).alias("score")), low_first)


def frames(y: np.ndarray, size: int = N_FFT, hop: int = HOP, mode: str = "constant") -> np.ndarray:
    y = np.pad(np.asarray(y, float), size // 2, mode=mode)
    n = 1 + max(0, len(y) - size) // hop
    y = np.pad(y, (0, max(0, size - len(y))))
    return np.lib.stride_tricks.as_strided(y, (n, size), (y.strides[0] * hop, y.strides[0]))


def stft(y: np.ndarray) -> np.ndarray:
    """Magnitudes (bins, frames) with a periodic Hann window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    return np.abs(np.fft.rfft(frames(y) * window, axis=1)).T


def _freqs(sr: int) -> np.ndarray:
    return np.fft.rfftfreq(N_FFT, 1 / sr)


def spectral_centroid(y, sr):
    s = stft(y)
    total = s.sum(0)
    return float(np.mean(np.where(total > 0, (_freqs(sr)[:, None] * s).sum(0) / np.maximum(total, 1e-300), 0.0)))


def spectral_bandwidth(y, sr):
    s = stft(y)
    p = s / np.maximum(s.sum(0), 1e-300)
    f = _freqs(sr)[:, None]
    c = (f * p).sum(0)
    return float(np.mean(np.sqrt((p * (f - c) ** 2).sum(0))))


def spectral_rolloff(y, sr, roll_percent: float = 0.85):
    s = np.cumsum(stft(y), axis=0)
    at = (s >= roll_percent * s[-1]).argmax(0)
    return float(np.mean(_freqs(sr)[at]))


def spectral_flatness(y, sr):
    p = np.maximum(stft(y) ** 2, 1e-10)
    return float(np.mean(np.exp(np.log(p).mean(0)) / p.mean(0)))


def zero_crossing_rate(y, sr):
    f = frames(y, mode="edge")
    return float(np.mean((np.diff(np.signbit(f), axis=1) != 0).mean(1))) if f.shape[1] > 1 else 0.0


def fundamental_frequency(y, sr, low: float = 65.4, high: float = 2093.0):
    """Mean pitch of voiced frames by cumulative-mean-normalised differences (YIN); none voiced gives 0."""
    out = []
    lo, hi = max(2, int(sr / high)), min(N_FFT // 2, int(sr / low) + 1)
    for f in frames(y):
        if np.abs(f).max() < 1e-6:
            continue
        half = N_FFT // 2
        power = np.concatenate([[0], np.cumsum(f * f)])
        corr = np.fft.irfft(np.fft.rfft(f, 2 * N_FFT) * np.conj(np.fft.rfft(f[:half], 2 * N_FFT)))[: half + 1]
        lag = np.arange(half + 1)
        d = power[half] + (power[np.minimum(lag + half, N_FFT)] - power[lag]) - 2 * corr
        cm = np.ones(half + 1)
        cm[1:] = d[1:] * lag[1:] / np.maximum(np.cumsum(d[1:]), 1e-12)
        good = np.flatnonzero(cm[lo:hi] < 0.15)
        if len(good):
            t = lo + good[0]
            while t + 1 < hi and cm[t + 1] < cm[t]:
                t += 1
            a, b, c = cm[t - 1], cm[t], cm[min(t + 1, half)]
            bend = a - 2 * b + c
            out.append(sr / (t + (0.5 * (a - c) / bend if bend else 0.0)))
    return float(np.mean(out)) if out else 0.0


def mel_bank(sr: int, n_mels: int = 128) -> np.ndarray:
    """Triangular filters on the Slaney mel scale, each of unit area."""
    hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    top = 15 + np.log(max(sr / 2, 1001) / 1000) * 27 / np.log(6.4)
    edge = hz(np.linspace(0, top, n_mels + 2))
    f = _freqs(sr)
    up = (f[None] - edge[:-2, None]) / np.diff(edge)[:-1, None]
    down = (edge[2:, None] - f[None]) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def mfcc(y, sr, n_mfcc: int = 13) -> np.ndarray:
    power = mel_bank(sr) @ stft(y) ** 2
    db = 10 * np.log10(np.maximum(power, 1e-10))
    db = np.maximum(db, db.max() - 80)
    n = len(db)
    basis = np.cos(np.pi * np.outer(np.arange(n_mfcc), np.arange(n) + 0.5) / n) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis @ db


def mfcc_mean(y, sr, n_mfcc: int = 13):
    return float(mfcc(y, sr, n_mfcc)[0].mean())


def mfcc_variance(y, sr, n_mfcc: int = 13):
    return float(mfcc(y, sr, n_mfcc).var(1).mean())


def onset_strength(y, sr) -> np.ndarray:
    """Half-wave rectified spectral flux of the mel spectrum in decibels."""
    db = 10 * np.log10(np.maximum(mel_bank(sr) @ stft(y) ** 2, 1e-10))
    db = np.maximum(db, db.max() - 80)
    return np.concatenate([[0.0], np.maximum(0, np.diff(db, axis=1)).mean(0)])


def tempo(y, sr):
    """Beats a minute at the strongest autocorrelation of the onset strength, weighted towards 120."""
    o = onset_strength(y, sr)
    o = o - o.mean()
    if not np.abs(o).max() > 1e-9:
        return 0.0
    a = np.correlate(o, o, "full")[len(o) - 1 :]
    lag = np.arange(1, len(a))
    bpm = 60 * sr / HOP / lag
    ok = (bpm >= 30) & (bpm <= 300)
    if not ok.any():
        return 0.0
    weight = np.exp(-0.5 * np.log2(bpm / 120) ** 2)
    return float(bpm[np.where(ok, a[1:] * weight, -np.inf).argmax()])


def beat_strength(y, sr):
    return float(onset_strength(y, sr).mean())


def _median(s: np.ndarray, size: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(s, pad, mode="reflect" if s.shape[axis] > size // 2 else "edge"), size, axis=axis), axis=-1)


def harmonic_ratio(y, sr):
    """Energy of the harmonic over that of the percussive part (median filters and soft masks)."""
    s = stft(y)
    h, p = _median(s, 31, 1) ** 2, _median(s, 31, 0) ** 2
    mask = h / np.maximum(h + p, 1e-20)
    return float(((s * mask) ** 2).sum() / (((s * (1 - mask)) ** 2).sum() + 1e-10))


def zlib_ratio(y, sr):
    """float32 bytes over deflated 16-bit bytes: the substitute for an OGG ratio where no codec is installed."""
    pcm = (np.clip(y, -1, 1) * 32767).astype(np.int16)
    return len(pcm) * 4 / max(1, len(zlib.compress(pcm.tobytes(), 6)))


SPECTRAL = {f.__name__: f for f in (spectral_centroid, spectral_bandwidth, spectral_rolloff, spectral_flatness, zero_crossing_rate, fundamental_frequency, mfcc_mean, mfcc_variance, tempo, beat_strength, harmonic_ratio, zlib_ratio)}


def spectral(audios: DataFrame, name: str, low_first: bool = True, **kwargs) -> DataFrame:
    """Rank (id, sr, y) by one of SPECTRAL; an empty signal scores 0."""
    if name not in SPECTRAL:
        raise ValueError(f"Unknown audio feature: {name}")
    score = SPECTRAL[name]

    @F.pandas_udf("double")
    def run(sr: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([score(np.asarray(v, float), int(r), **kwargs) if len(v) else 0.0 for r, v in zip(sr, y)], dtype="float64")

    return _ranked(audios.select("id", run("sr", "y").alias("score")), low_first)
