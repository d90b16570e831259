"""Language identification by a blended-spectrum string kernel, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the number of character n-grams (n = 1..ORDER) present in both, normalised by the root of
the products of their own numbers. n-grams are hashed into ``BUCKETS`` places, far more than all but the longest texts
have, so presence is a sparse row of flags. The scores of a batch are P Z'B / |P|: its presence matrix P times the
landmarks' presence Z' times the coefficients B. Z'B is one matrix for all texts, which leaves one sparse product a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.llm._rows import filter_rows
from cleaveset.llm._sample import hash_sample

BITS = 18
BUCKETS = 1 << BITS
ORDER = 3
BATCH = 64
UND = "und"
#: Bounds of the labelled sample that fits the classifier, and of the landmarks among it: for each language, and in all.
PER_LANGUAGE, LANDMARKS = 400, 24
SAMPLE, ALL_LANDMARKS = 8000, 1200
RIDGE = 1e-4


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the flags of each text: lower-cased, runs of ASCII other than letters as one space."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    code = np.concatenate([np.concatenate(([32], p, [32])) for p in points]).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(p) + 2 for p in points])
    code[(code < 128) & ~((code >= 97) & (code <= 122))] = 32
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[keep].astype(np.uint64), row[keep]
    h = np.zeros(len(code), np.uint64)
    flags = np.zeros(len(texts) * BUCKETS, bool)
    for n in range(1, ORDER + 1):
        h = (h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)) & np.uint64(0xFFFFFFFFFFFF)
        place = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        same = row[: len(place)] == row[n - 1 :]
        flags[(row[: len(place)] * BUCKETS + place)[same]] = True
    at = np.flatnonzero(flags)
    return at >> BITS, at & (BUCKETS - 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def pack(places: np.ndarray) -> bytes:
    """Places as numbers or as bits, whichever is shorter: at most BUCKETS / 8 bytes."""
    if 4 * len(places) < BUCKETS // 8:
        return b"n" + places.astype(np.uint32).tobytes()
    bits = np.zeros(BUCKETS, bool)
    bits[places] = True
    return b"b" + np.packbits(bits).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"n":
        return np.frombuffer(raw[1:], np.uint32).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw[1:], np.uint8)))


def kernel(rows: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Normalised n-gram presence kernel of each row with each landmark."""
    flat = np.concatenate(rows)
    start = np.cumsum([0, *map(len, rows[:-1])])
    out = np.empty((len(rows), len(marks)))
    for j, m in enumerate(marks):
        flag = np.zeros(BUCKETS, np.int64)
        flag[m] = 1
        out[:, j] = np.add.reduceat(flag[flat], start)
    size = lambda x: np.sqrt([len(p) for p in x])
    return out / np.outer(size(rows), size(marks))


def solve(rows: list[np.ndarray], lang: list[str], landmarks: int, ridge: float) -> tuple[list[str], np.ndarray]:
    """(languages, Z'B): ridge regression on the kernel with the first ``landmarks`` rows of each language."""
    names = sorted(set(lang))
    landmarks = min(landmarks, max(1, ALL_LANDMARKS // len(names)))
    y = np.array([[1.0 if x == n else 0.0 for n in names] for x in lang])
    taken: dict[str, int] = {}
    mark = []
    for k, x in enumerate(lang):
        taken[x] = taken.get(x, 0) + 1
        if taken[x] <= landmarks:
            mark.append(k)
    marks = [rows[k] for k in mark]
    knm = kernel(rows, marks)
    weight = 1.0 / (y @ y.sum(0))  # each language counts alike
    weight *= len(rows) / weight.sum()
    left = (knm * weight[:, None]).T @ knm + ridge * len(rows) * knm[mark] + 1e-9 * np.eye(len(mark))
    alpha = np.linalg.solve(left, (knm * weight[:, None]).T @ y)
    out = np.zeros((BUCKETS, len(names)))
    for m, a in zip(marks, alpha):
        out[m] += a / np.sqrt(len(m))
    return names, out


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, landmarks: int, ridge: float) -> tuple[list[str], np.ndarray]:
    """(languages, weight of each place for each language) from a bounded sample of rows with a label and a letter."""
    own = train.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    own = own.where(F.col("i").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages = own.select("lang").distinct().count()
    chosen = hash_sample(own, "lang", languages, min(per_language, max(1, SAMPLE // max(1, languages))), "text", F.md5("text"))

    def run(found):
        for b in found:
            ok = [(k, t) for k, t in enumerate(b.column(2).to_pylist()) if has_letter(t)]
            at = pa.array([k for k, _ in ok], pa.int64())
            packed = [pack(presence([t])[1]) for _, t in ok]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at).cast(pa.int32()), pa.array(packed, pa.binary())], ["lang", "rank", "places"])

    rows = chosen.select("lang", "rank", "text").mapInArrow(run, "lang string, rank int, places binary").collect()  # at most SAMPLE rows (or one a language) of BUCKETS / 8 bytes
    rows.sort(key=lambda r: (r.lang, r.rank))
    if not rows:
        return [], np.zeros((BUCKETS, 0))
    return solve([unpack(bytes(r.places)) for r in rows], [r.lang for r in rows], landmarks, ridge)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> DataFrame:
    """Predicted language of every whole text.

    The classifier is fitted on a bounded sample of the labelled rows whose crc32(id as text) mod 5 isn't 0: at most
    ``per_language`` rows of each language and about SAMPLE in all, those with the smallest hashes, of which ``landmarks``
    a language and ALL_LANDMARKS in all are the Nystroem landmarks. One-versus-rest ridge regression gives each language
    a value of about 1 for its texts and 0 for others; the score is the largest, clipped to 0..1.

    * Null text, or one without a letter: ``und`` with score 0. Such rows and those with a null label or id aren't learnt
      from; a row with a null id counts as not held out. With nothing to learn from, all are ``und``.
    * Very long texts are taken whole; memory is that of one text's characters beside BUCKETS flags.
    * Ties of languages go to the earlier name. Repeated rows repeat their result and are one row of the sample; rows of
      one id with different texts are ranked by the digest of the text.
    * An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    held = _held_out(id_col)
    model = _model(docs, id_col, text_col, lang_col, per_language, landmarks, ridge)

    def predict(found):
        predictor = Predictor(*model.value)
        for b in found:
            lang, score = predictor(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is identified, with all their columns: ``und`` and scores below ``least`` are rejected.

    Rows are judged as in ``identify``: null, empty and letterless texts go, repeated rows go or stay together, very long
    texts are read whole, and an empty table gives an empty one. Columns are carried by place, so no name can clash.
    """
    model = _model(docs, id_col, text_col, lang_col, PER_LANGUAGE, LANDMARKS, RIDGE)

    def judge():
        predictor = Predictor(*model.value)

        def keep(column: pa.Array) -> pa.Array:
            lang, score = predictor(column.to_pylist())
            return pa.array((np.array(lang, object) != UND) & (score >= least))

        return keep

    return filter_rows(docs, text_col, judge)


def _held_out(id_col: str):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5).eqNullSafe(0)


def _model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, landmarks: int, ridge: float):
    names, weight = fit(docs.where(~_held_out(id_col)), id_col, text_col, lang_col, per_language, landmarks, ridge)
    used = np.flatnonzero(weight.any(1))  # places that no landmark has weigh nothing
    return docs.sparkSession.sparkContext.broadcast((names, used.astype(np.int32), weight[used].astype(np.float32)))  # bounded by BUCKETS and the languages


class Predictor:
    """Scores texts by batches: the sparse presence matrix times the weights of the places."""

    def __init__(self, names: list[str], used: np.ndarray, weight: np.ndarray):
        self.names = names
        self.weight = np.concatenate([weight, np.zeros((1, weight.shape[1]), np.float32)])  # the last row: no weight
        self.at = np.full(BUCKETS, len(used), np.int32)
        self.at[used] = np.arange(len(used))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = [UND] * len(texts), np.zeros(len(texts))
        ok = [k for k, t in enumerate(texts) if self.names and has_letter(t)]
        for a, e in _groups([len(texts[k]) for k in ok]):
            part = ok[a:e]
            row, place = presence([texts[k] for k in part])
            start = np.searchsorted(row, np.arange(len(part)))
            value = np.add.reduceat(self.weight[self.at[place]], start, axis=0) / np.sqrt(np.bincount(row, minlength=len(part)))[:, None]
            for k, j, v in zip(part, value.argmax(1), value.max(1)):
                lang[k] = self.names[j]
                score[k] = min(1.0, max(0.0, float(v)))
        return lang, score


def _groups(lengths: list[int], most: int = 400_000):
    """Ranges of at most BATCH texts and about ``most`` characters."""
    a, total = 0, 0
    for k, n in enumerate(lengths):
        if k > a and (k - a == BATCH or total + n > most):
            yield a, k
            a, total = k, 0
        total += n
    if lengths:
        yield a, len(lengths)
