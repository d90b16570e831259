"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.llm._sample import hash_sample
from cleaveset.llm._trees import Boosted, isotonic
from cleaveset.llm._words import slices, text_bytes

#: Bounds of the labelled sample for each label value, and of the learnt part of the lexicon.
PER_LABEL, LEXICON = 5000, 4000
#: What orders rows within a flat step of the calibration.
STEP = 1e-6
SEED = set("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns dumb fool ugly hate kill filth filthy vermin bastard crap imbecile idiota estúpido estupido basura asqueroso inútil payaso tonto imbécil dummkopf trottel abschaum ekelhaft erbärmlich wertlos hässlich imbécile stupide ordure minable dégoûtant crétin".split())
YOU = set("you your yours yourself u ur ya tu tú te ti usted ustedes vos vosotros du dich dir dein deine ihr euch sie vous toi ton ta tes votre vos".split())
LEET = str.maketrans("4@3!1|0$57", "aaeiiiosst")
EDGES = ".,;:!?\"'()[]{}<>*#%&$-_~`"
UNITS = (4, 5, 6)
NAMES = ("words", "hits", "density", "weight", "top", "distinct", "seed", "seed_density", "near_you", "you", "capitals", "marks", "bangs", "obfuscated", "digits")
_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 mark, 3 exclamation or question mark, 4 digit
_CLASS[65:91] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_CLASS[[33, 63]] = 3
_CLASS[48:58] = 4


def units(word: str) -> list[str]:
    """The word and its beginnings, under which inflected and compounded forms of a stem meet."""
    return [word] + [f"{word[:n]}-" for n in UNITS if len(word) >= n]


def plain(word: str) -> tuple[str, bool]:
    """(letters of the lower-cased word, whether it was obfuscated: symbols or digits among its letters)."""
    word = word.strip(EDGES)
    if word.isalpha():
        return word, False
    other = "".join(c for c in word.translate(LEET) if c.isalpha())
    return other, len(other) > 2 and word[:1].isalpha() and any(not c.isalpha() and c not in "'-.,:/’" for c in word[1:])


class Memo(dict):
    """word -> 0, or (weight, in seed, second person, obfuscated)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) > 100_000:
            self.clear()
        letters, odd = plain(word)
        weight = max((self.lexicon.get(u, 0.0) for u in units(letters)), default=0.0) if letters else 0.0
        seed, you = letters in SEED, letters in YOU
        found = (weight, seed, you, odd) if weight or seed or you or odd else 0
        self[word] = found
        return found


def features(column: pa.Array, memo: Memo) -> np.ndarray:
    raw, offsets = text_bytes(column)
    out = np.zeros((len(column), len(NAMES)))
    for k, text in enumerate(column):
        text = text.as_py()
        words = (text or "").lower().split()
        n = max(1, len(words))
        marked = [(i, m) for i, m in enumerate(map(memo.__getitem__, words)) if m]
        toxic = [(i, m[0]) for i, m in marked if m[0] or m[1]]
        you = [i for i, m in marked if m[2]]
        weight = [m[0] for _, m in marked if m[0]]
        near = sum(any(abs(i - j) <= 5 for j in you) for i, _ in toxic) if len(you) <= 64 else sum(_near(i, you) for i, _ in toxic)
        seeds = sum(m[1] for _, m in marked)
        out[k, :10] = (math.log1p(len(words)), len(weight), len(weight) / n, sum(weight), max(weight, default=0.0), len({words[i] for i, m in marked if m[0]}), seeds, seeds / n, near, len(you) / n)
        out[k, 13] = sum(m[3] for _, m in marked) / n
    size = np.maximum(1, np.diff(offsets))
    for a, b in slices(offsets):
        kind = _CLASS[raw[offsets[a] : offsets[b]]]
        for c, at in ((0, 10), (1, 11), (2, 12), (3, 14)):
            total = np.concatenate([[0], np.cumsum(kind == c + 1, dtype=np.int64)])[offsets[a : b + 1] - offsets[a]]
            out[a:b, at] = np.diff(total) / size[a:b]
    return out


def _near(i: int, you: list[int]) -> bool:
    from bisect import bisect_left

    at = bisect_left(you, i - 5)
    return at < len(you) and you[at] <= i + 5


def _lexicon(counts: list, t: float, n: float, least: int, most: int) -> dict[str, float]:
    """Units much commoner in toxic than in other rows, with shrunken log odds; the ``most`` heaviest of them."""
    found = {}
    for unit, toxic, clean in counts:
        if toxic < least:
            continue
        odds = math.log((toxic + 0.5) / (t + 1)) - math.log((clean + 0.5) / (n + 1))
        if odds > 2.0:
            found[unit] = odds * toxic / (toxic + 3.0)
    best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]
    return dict(best)


def fit(rows: DataFrame, labels: DataFrame, per_label: int, lexicon: int = LEXICON):
    """(lexicon, trees, calibration knots); rows has (doc_id, text), labels (doc_id, toxic).

    The sample has one text an id, that of the smallest digest where rows repeat an id, so it is bounded by its ids.
    """
    sc = rows.sparkSession.sparkContext
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    totals = dict(known.groupBy("toxic").count().collect())  # two rows
    ids = known.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("toxic"), F.lit(0).alias("v"))
    chosen = hash_sample(ids, "toxic", 2, per_label, "v", F.lit(0)).select(F.col("i").alias("doc_id"), "toxic", (F.col("rank") % 2).alias("fold"))
    have = rows.withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(chosen), "doc_id")  # at most per_label of each label
    sample = have.groupBy("doc_id", "fold", "toxic").agg(F.min_by("text", F.md5("text")).alias("text")).select(F.col("fold").cast("int").alias("fold"), "toxic", "text")

    def count(found):
        seen: dict = {}
        docs: dict = {}
        for b in found:
            for fold, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                docs[fold, toxic] = docs.get((fold, toxic), 0) + 1
                have = {u for w in set((text or "").lower().split()) for u in units(plain(w)[0]) if len(u) > 2}
                at = fold * 2 + toxic
                for u in have:
                    if u not in seen:
                        seen[u] = [0, 0, 0, 0]
                    seen[u][at] += 1
        for (fold, toxic), n in docs.items():
            seen.setdefault("", [0, 0, 0, 0])[fold * 2 + toxic] += n
        keys = list(seen)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[u][j] for u in part], pa.int64()) for j in range(4))], ["unit", "c0", "t0", "c1", "t1"])

    counted = sample.mapInArrow(count, "unit string, c0 long, t0 long, c1 long, t1 long").groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    odds = (F.col("t0") + F.col("t1")) / (F.col("c0") + F.col("c1") + 1.0)
    total = totals.get(1, 0), totals.get(0, 0)
    ratio = min(total[0], per_label) / max(1, min(total[1], per_label))
    likely = counted.where((F.col("unit") == "") | ((F.col("t0") + F.col("t1") >= 3) & (odds > 2.0 * ratio)))
    counts = likely.orderBy(F.col("unit") != "", (-(F.col("t0") + F.col("t1"))), "unit").limit(lexicon * 20).collect()  # a top list of units, at most 20 for each entry
    size = next(([r.c0, r.t0, r.c1, r.t1] for r in counts if r.unit == ""), [0, 0, 0, 0])
    if not (size[1] + size[3]) or not (size[0] + size[2]):
        return None
    own = [r for r in counts if r.unit]
    least = 3
    whole = _lexicon([(r.unit, r.t0 + r.t1, r.c0 + r.c1) for r in own], size[1] + size[3], size[0] + size[2], least, lexicon)
    folds = [_lexicon([(r.unit, r.t1, r.c1) for r in own], size[3], size[2], least - 1, lexicon), _lexicon([(r.unit, r.t0, r.c0) for r in own], size[1], size[0], least - 1, lexicon)]
    shared = sc.broadcast(folds)  # at most ``lexicon`` entries each

    def featurise(found):
        memo = [Memo(x) for x in shared.value]
        for b in found:
            fold = np.array(b.column(0).to_pylist(), int)
            x = np.zeros((b.num_rows, len(NAMES)))
            for f in (0, 1):
                at = np.flatnonzero(fold == f)
                x[at] = features(b.column(2).take(pa.array(at)), memo[f]) if len(at) else x[at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["fold", "toxic", "x"])

    data = sample.mapInArrow(featurise, "fold int, toxic int, x array<double>").collect()  # at most 2 * per_label rows of 15 numbers
    data.sort(key=lambda r: (r.fold, r.toxic, r.x))
    x = np.array([r.x for r in data])
    y = np.array([r.toxic for r in data], float)
    fold = np.array([r.fold for r in data])
    rate = {1: total[0] / max(1.0, y.sum()), 0: total[1] / max(1.0, (1 - y).sum())}
    w = np.where(y == 1, rate[1], rate[0])
    w *= len(w) / w.sum()
    out = np.zeros(len(y))
    for f in (0, 1):
        here = fold == f
        if here.all() or not here.any():
            continue
        out[here] = Boosted().fit(x[~here], y[~here], w[~here]).predict(x[here])
    return whole, Boosted().fit(x, y, w), isotonic(out, y, w)


def calibrated(odds: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The isotonic value of log odds, with the odds' order within its flat steps; the side of 0.5 stays."""
    value = np.clip(np.interp(odds, *knots), 0.0, 1.0)
    order = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return np.clip(STEP + (1 - 2 * STEP) * value + STEP * (order - (value < 0.5)), 0.0, 1.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, lexicon: int = LEXICON) -> DataFrame:
    """Calibrated probability that a whole text is toxic.

    Trees are fitted on a bounded sample of labelled rows whose crc32(id as text) mod 5 isn't 0: at most ``per_label``
    of each label, those with the smallest hashes, weighted back to the labels' true shares. The learnt part of the
    lexicon has at most ``lexicon`` words and word beginnings commoner in toxic rows of that sample; each half of it gets
    features from the other half's lexicon, and the calibration is fitted on predictions across the halves. The score is
    the isotonic value, moved by at most 2 * STEP to order rows within its flat steps, never across 0.5.

    * Null and empty texts are scored as texts without words. Null ids and labels other than 0 and 1 aren't learnt from; a
      row with a null id counts as not held out; several labels of one id count as toxic if one is.
    * Very long texts are read whole, word by word. Repeated rows repeat their result; of the rows of one id, one is
      learnt from. Equal features tie.
    * Without both labels to learn from, the score is 0. An empty table gives an empty result. Other columns are ignored,
      whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels.select("doc_id", "toxic"), per_label, lexicon))

    def predict(found):
        have = model.value
        memo = Memo(have[0]) if have else None
        for b in found:
            if have:
                score = calibrated(have[1].predict(features(b.column(2), memo)), have[2])
            else:
                score = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).eqNullSafe(0).alias("held_out")
    return rows.select("doc_id", held, "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, score double, predicted int")
