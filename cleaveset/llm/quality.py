"""Quality by weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer on their posteriors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.llm._sample import hash_sample
from cleaveset.llm._store import Store
from cleaveset.llm._words import batches, text_bytes

LABELLERS = ("length", "word_length", "symbols", "capitals", "repeated_words", "sentences", "markup", "digits", "common_words")
#: Bound of the rows that train the linear scorer, for each side of the posterior.
PER_SIDE = 6000
BUCKETS = 1 << 15
COMMON = set("the of and to in is that a it for was on are as with be by this de la que el en y los del se las un por con no una su para es al lo como le et des les dans du une est pour qui au sur pas der die das und ist nicht von mit den ein eine zu auf für im dem".split())


def votes(text: str) -> tuple[int, ...]:
    """One vote of each labeller: 1 good, 0 bad, -1 abstains."""
    words = text.split()
    n, m = len(words), max(1, len(text))
    if not n:
        return (0,) + (-1,) * (len(LABELLERS) - 1)
    out = [0 if n < 8 else 1 if n >= 40 else -1]
    mean = sum(map(len, words)) / n
    out.append(1 if 2.5 <= mean <= 9 else 0 if mean > 14 or mean < 1.8 else -1)
    plain = sum(map(text.count, " \n.,;:!?'\"-()"))
    letters = len(text) - plain
    odd = sum(map(text.count, "#$%&*<>{}[]|\\~^=_+@")) / m
    out.append(0 if odd > 0.06 else 1 if odd < 0.01 else -1)
    head = sum(1 for w in words if len(w) > 1 and w.isupper()) / n
    out.append(0 if head > 0.3 else 1 if head < 0.05 else -1)
    if n >= 20:
        distinct = len(set(words)) / n ** 0.9
        twice = sum(a == b for a, b in zip(words, words[1:])) / n
        out.append(0 if distinct < 0.35 or twice > 0.1 else 1 if distinct > 0.55 and twice < 0.02 else -1)
    else:
        out.append(-1)
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    out.append(-1 if n < 15 else 1 if 3 <= n / max(ends, 0.1) <= 60 else 0 if text.count("!") / n > 0.3 or ends == 0 and n > 60 else -1)
    out.append(0 if (text.count("|") + text.count("<")) / n > 0.1 else 1 if letters and "|" not in text and "<" not in text else -1)
    digits = sum(map(text.count, "0123456789")) / m
    out.append(0 if digits > 0.15 else 1 if digits < 0.03 else -1)
    common = sum(1 for w in words if w.lower() in COMMON) / n
    out.append(-1 if n < 15 else 1 if 0.08 <= common <= 0.7 else 0)
    return tuple(out)


def code(vote: tuple[int, ...]) -> int:
    out = 0
    for v in vote:
        out = out * 3 + v + 1
    return out


def decode(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (len(LABELLERS) - 1 - j) % 3 - 1 for j in range(len(LABELLERS))], 1)


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each vote pattern, accuracy of each labeller on (bad, good), share of good).

    Two-class Dawid-Skene with abstentions left out. It starts from accuracies of 0.8, which makes the majority's side
    the label, and a weak beta prior keeps accuracies inside 0.5..1 of a fresh labeller.
    """
    j = patterns.shape[1]
    accuracy = np.full((2, j), 0.8)
    prior = 0.7
    post = np.full(len(n), prior)
    for _ in range(rounds):
        good = np.log(prior) + np.where(patterns == 1, np.log(accuracy[1]), np.where(patterns == 0, np.log(1 - accuracy[1]), 0.0)).sum(1)
        bad = np.log(1 - prior) + np.where(patterns == 0, np.log(accuracy[0]), np.where(patterns == 1, np.log(1 - accuracy[0]), 0.0)).sum(1)
        new = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        w1, w0 = n * new, n * (1 - new)
        accuracy = np.stack([
            (w0 @ (patterns == 0) + 8) / (w0 @ (patterns >= 0) + 10),
            (w1 @ (patterns == 1) + 8) / (w1 @ (patterns >= 0) + 10),
        ])
        prior = float(min(0.999, max(0.001, w1.sum() / max(n.sum(), 1))))
        moved = np.abs(new - post).max() if len(post) else 0.0
        post = new
        if moved < 1e-9:
            break
    return post, accuracy, prior


def hashed(column: pa.Array):
    """(row of each feature, feature) of the hashed shapes of a text column, with the rows' feature counts.

    Features are presences: of words, and of word endings with the shape of the characters (letters, capitals, digits,
    other) with their neighbours', which are hashed into BUCKETS places.
    """
    raw, offsets = text_bytes(column)
    kind = np.zeros(256, np.uint64)
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[128:] = 1
    for c in b"#$%&*<>{}[]|\\~^=_+@!?.,;:'\"-()/":
        kind[c] = c
    kind[[9, 10, 11, 12, 13, 32]] = 4
    rows, places = [], []
    for a, b, h, bounds in batches(column):
        row = np.repeat(np.arange(b - a), np.diff(bounds))
        shape = kind[raw[offsets[a] : offsets[b]]]
        where = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        tri = (shape[:-3] * np.uint64(0x1F123BB5) + shape[1:-2] * np.uint64(0x2545F491) + shape[2:-1] * np.uint64(0x5851F42D) + shape[3:] * np.uint64(0x14057B7E)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 14)
        same = where[:-3] == where[3:] if len(where) > 3 else np.zeros(0, bool)
        half = BUCKETS // 2
        flat = np.zeros((b - a) * BUCKETS, bool) if b - a <= 64 else None
        word = (h >> np.uint64(64 - 14)).astype(np.int64) + half
        one = np.concatenate([row * BUCKETS + word, where[:-3][same] * BUCKETS + tri[same].astype(np.int64)]) if len(where) > 3 else row * BUCKETS + word
        if flat is not None:
            flat[one] = True
            at = np.flatnonzero(flat)
        else:
            at = np.unique(one)
        rows.append(at // BUCKETS + a)
        places.append(at % BUCKETS)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), (np.concatenate(places) if places else np.zeros(0, np.int64))


def train(rows: list[tuple[float, np.ndarray]], rounds: int = 12, rate: float = 0.5, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on presences scaled to unit length, by adaptive gradients in fixed order."""
    w, g2, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0
    order = np.random.RandomState(11)
    for _ in range(rounds):
        for start in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            part = [rows[i] for i in start]
            at = np.concatenate([p for _, p in part])
            who = np.repeat(np.arange(len(part)), [len(p) for _, p in part])
            unit = 1 / np.sqrt(np.maximum(1, np.bincount(who, minlength=len(part))))
            f = np.bincount(who, w[at], len(part)) * unit + bias
            err = 1 / (1 + np.exp(-np.clip(f, -50, 50))) - np.array([y for y, _ in part])
            grad = np.bincount(at, (err * unit)[who], BUCKETS) / len(part) + ridge * w
            g2 += grad**2
            w -= rate * grad / np.sqrt(g2)
            bias -= 0.1 * err.mean()
    return w, bias


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_side: int = PER_SIDE, least: float = 0.5) -> DataFrame:
    """Quality score of every whole text, learnt without labels.

    One pass over the texts stores each row's vote pattern and hashed features. The patterns of all rows are counted (at
    most 3 ** 9 of them), EM estimates the labellers' accuracies from the counts, and each pattern's posterior labels its
    rows. The linear scorer is trained on a bounded sample: at most ``per_side`` rows of each side of the posterior,
    those with the smallest id hashes.

    Returns doc_id, posterior (of the votes), score (of the linear scorer, 0..1), keep (score >= least).

    * Null text is an empty one, on which all labellers but length abstain. Rows with a null id are scored but don't train.
    * Very long texts are read whole; their features are at most BUCKETS presences.
    * Repeated rows repeat their result and are one row of the sample; rows of one id with different texts are ranked by
      their features. A posterior of exactly a half counts as good.
    * An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def extract(found):
        for b in found:
            row, place = hashed(b.column(1))
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            pattern = pa.array([code(votes(t or "")) for t in b.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pattern, pa.array([packed(place[cut[k] : cut[k + 1]]) for k in range(b.num_rows)], pa.binary())], ["doc_id", "pattern", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    seen = Store(spark).keep(rows.mapInArrow(extract, f"doc_id {kind}, pattern int, f binary"), "features")
    counts = sorted((r.pattern, r["count"]) for r in seen.groupBy("pattern").count().collect())  # at most 3 ** 9 rows
    codes = np.array([c for c, _ in counts], np.int64)
    post, _, _ = expectation_maximisation(decode(codes), np.array([n for _, n in counts], float))
    table = dict(zip(codes.tolist(), post.tolist()))
    sides = spark.createDataFrame([(c, int(p >= 0.5)) for c, p in table.items()], "pattern int, side int")
    own = seen.where(F.col("doc_id").isNotNull()).join(F.broadcast(sides), "pattern")  # at most 3 ** 9 patterns
    sample = hash_sample(own.select(F.col("doc_id").alias("i"), "side", F.struct("pattern", "f").alias("v")), "side", 2, per_side, "v", F.md5("v.f"))
    data = sample.select("side", "rank", "v.pattern", "v.f").collect()  # at most 2 * per_side rows of 2 * BUCKETS bytes
    data.sort(key=lambda r: (r.side, r["rank"]))
    w, bias = train([(table[r.pattern], unpacked(bytes(r.f))) for r in data]) if data else (np.zeros(BUCKETS), 0.0)
    scorer = spark.sparkContext.broadcast((w, bias, table))

    def score(found):
        w, bias, table = scorer.value
        for b in found:
            places = [unpacked(f) for f in b.column(2).to_pylist()]
            s = linear(places, w, bias)
            p = [table[c] for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array((s >= least).astype(np.int32))], ["doc_id", "posterior", "score", "keep"])

    return seen.mapInArrow(score, f"doc_id {kind}, posterior double, score double, keep int")


def packed(places: np.ndarray) -> bytes:
    """Sorted places below 2 ** 16 as their gaps, high and low bytes apart, which compress well."""
    gap = np.diff(places, prepend=0).astype(np.uint16)
    return gap.view(np.uint8).reshape(-1, 2).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    halves = np.frombuffer(raw, np.uint8).reshape(2, -1)
    return np.cumsum(halves[0].astype(np.int64) + 256 * halves[1].astype(np.int64))


def linear(places: list[np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    """Probability of good for each row of presences, scaled to unit length."""
    size = np.array([len(p) for p in places], np.int64)
    row = np.repeat(np.arange(len(places)), size)
    f = np.bincount(row, w[np.concatenate(places)] if len(places) else [], len(places)) / np.sqrt(np.maximum(1, size)) + bias
    return 1 / (1 + np.exp(-np.clip(f, -50, 50)))
