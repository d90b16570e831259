"""Secret scan: fixed patterns, and password guess-cost dynamic programming on values in credential contexts."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.llm._store import Store

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as [0-9a-f]+ of 32 and more
KINDS = ("assign", "access", "hex", "guess")
#: Contexts of the added kind: more names, more separators. A value is quoted or runs to white space or markup.
HEAD = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credential|private[_-]?key|auth[_-]?key|access[_-]?key|bearer)"""
    r"""(?:(?P<sign>["']?\x20*(?::=|=>|[:=])\x20*)|\x20+(?:(?:is|was)\x20+)?)""",
    re.IGNORECASE | re.ASCII,
)
QUOTED = {'"': re.compile(r'"((?:[^"\\\n]|\\.){6,})"'), "'": re.compile(r"'((?:[^'\\\n]|\\.){6,})'")}
STOP = re.compile(r"\s|</?[a-z!]", re.IGNORECASE)
LEAST_LENGTH = 6
#: What may stand between a bare value and the next context, and after a bare value without being part of it.
BETWEEN = ",;&|<>(){}[]\"'"
AFTER = ",;<>\"'"
PROSE = re.compile(r"(?:[^\W\d_]?[^\W\d_A-Z]*|[A-Z]+)(?:\s+(?:[^\W\d_]?[^\W\d_A-Z]*|[A-Z]+))*")
#: Names for a value instead of one: variables, templates, calls and vault headers; and links that carry no user.
PLACE = re.compile(r"\$\{?[A-Za-z_][\w.]*\}?[;.]?.{0,3}|\$\(.*\)|\{\{?.*\}\}?|<[^>]*>?|%\(?\w+\)?[sd]?|[A-Za-z_][\w.]*(?:\(.*\)|\[.*\])[.;]?|[A-Za-z_]+(?:\.[A-Za-z_]+)+", re.ASCII | re.DOTALL)
LINK = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/@\s]*(?:[/?#][^@]*)?")
CUES = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")

WORDS = (
    "password passwd pass secret token admin administrator root user login welcome letmein monkey dragon master shadow sunshine princess football baseball "
    "iloveyou qwerty abc hello love god money test guest default changeme example sample demo the and for with you this that from have not are was but his her "
    "summer winter spring autumn january february march april may june july august september october november december monday tuesday wednesday thursday friday "
    "saturday sunday server database system service account private public access key client apple orange banana cheese coffee computer internet michael jordan "
    "charlie thomas robert daniel jessica ashley superman batman trustno starwars whatever freedom hunter killer soccer hockey ranger buster pepper ginger harley "
    "einen haus passwort geheim schule sommer winter contraseña clave secreto casa amor motdepasse secret bonjour soleil maison azerty"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
#: Words that the scan learns from its corpus at most, and their longest length.
DICTIONARY, LONGEST = 50_000, 24
LETTERS = re.compile(r"[^\W\d_]{3,24}")
LEET = str.maketrans("4@3!10$57", "aaeiiosst")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiopü", "azertyuiop")
NEXT = {frozenset(p) for r in ROWS for p in zip(r, r[1:])} | {frozenset(p) for a, b in zip(ROWS[:3], ROWS[1:4]) for p in zip(a, b)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
#: Spans of a long run begin at most so far after its start or end at most so far before its end.
NEAR = 64


def _brute(text: str) -> float:
    """log10 guesses of one character by brute force, by the classes that occur in the value."""
    have = set(text)
    size = 26 * any(c.islower() for c in have) + 26 * any(c.isupper() for c in have) + 10 * any(c.isdigit() for c in have) + 33 * any(not c.isalnum() for c in have)
    return math.log10(max(size, 10))


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def walk_step(a: str, b: str) -> int:
    """Direction of the step between two characters: +1 or -1 in the alphabet, 2 to a keyboard neighbour, else 0."""
    d = ord(b) - ord(a)
    return d if abs(d) == 1 and a.isalnum() and b.isalnum() else 2 if frozenset((a, b)) in NEXT else 0


def guess_cost(value: str, ranks: dict[str, int] = RANK, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs; at least ``enough`` if it reaches that.

    The minimum over segmentations into spans: a dictionary word (its rank; twice for capitals, about three times for
    substituted letters), a date, a repeat of one unit of up to four characters, a keyboard walk or a run of one
    alphabet, or a single character by brute force. Each longer span after the first costs 0.3 more for the order of the
    parts. Positions are settled in the order of their cost, so a strong value is left after its first spans whatever its
    length; of a run of more than 2 * NEAR characters, spans begin near its start and end near its start or its end.
    """
    n = len(value)
    if not n:
        return 0.0
    low = _lower(value)
    plain = low.translate(LEET)
    char = _brute(value)
    best, done, queue = {0: 0.0}, set(), [(0.0, 0)]
    periods: dict[int, tuple[int, int]] = {}
    walks = (0, 0)

    def offer(at: int, cost: float) -> None:
        if cost < best.get(at, math.inf):
            best[at] = cost
            heapq.heappush(queue, (cost, at))

    while queue:
        cost, i = heapq.heappop(queue)
        if i in done:
            continue
        if i == n or cost >= enough:
            return cost
        done.add(i)
        start = cost + (0.3 if i else 0.0)
        offer(i + 1, cost + char)
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank, leet = ranks.get(low[i:j]), False
            if rank is None:
                rank, leet = ranks.get(plain[i:j]), True
            if rank is not None:
                offer(j, start + math.log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0.0) + (0.5 if leet else 0.0))
        if low[i].isdigit() and (m := DATE.match(low, i)):
            offer(m.end(), start + math.log10(365.0 * 120))
        if i + 1 < n and (step := walk_step(low[i], low[i + 1])):
            if not walks[0] <= i < walks[1] - 1:
                e = i + 2
                while e < n and walk_step(low[e - 1], low[e]) == step:
                    e += 1
                walks = (i, e)
            for e in _ends(i, 3, 1, walks):
                offer(e, start + math.log10(26.0 * 2 * (e - i) * (4 if step == 2 else 1)))
        for unit in (1, 2, 3, 4):
            if i + 2 * unit > n:
                break
            if unit not in periods or not periods[unit][0] <= i <= periods[unit][1] - 2 * unit:
                periods[unit] = (i, _period_end(value, i, unit))
            for e in _ends(i, 2 * unit, unit, periods[unit]):
                offer(e, start + unit * char + math.log10((e - i) / unit))
    return best[n]


def _period_end(value: str, i: int, unit: int) -> int:
    """End of the longest run from i in which each character repeats the one ``unit`` before it."""
    e, step = i + unit, 4096
    while value[e : e + step] == value[e - unit : e - unit + len(value[e : e + step])] and e < len(value):
        e += step
    e = min(e, len(value))
    while e < len(value) and value[e] == value[e - unit]:
        e += 1
    return e


def _ends(i: int, least: int, unit: int, run: tuple[int, int]):
    """Ends of the spans from i in a run: all of a short one, else those near its ends if i is near its start."""
    last = i + (run[1] - i) // unit * unit
    if run[1] - run[0] <= 2 * NEAR:
        yield from range(i + least, last + 1, unit)
    elif i - run[0] <= NEAR:
        yield from range(i + least, min(run[0] + NEAR, last) + 1, unit)
        yield from range(max(i + least, last - NEAR // unit * unit), last + 1, unit)
    elif run[1] - i <= NEAR:
        yield from range(i + least, last + 1, unit)


def contexts(text: str):
    """(start, end, whether a sign separates) of the values in credential contexts, overlapping ones too.

    A value that is itself a context with a value gives way to it. A bare value ends before a further context behind
    punctuation, and at the quote that stands before its own context.
    """
    found, a, stop = [], -1, -1
    for m in HEAD.finditer(text):
        a = m.end()
        quote = text[a : a + 1]
        if quote in QUOTED and (q := QUOTED[quote].match(text, a)):
            found.append((m, *q.span(1), True))
            continue
        a += quote in QUOTED
        if stop < a:
            stop = s.start() if (s := STOP.search(text, a)) else len(text)
        if stop - a >= LEAST_LENGTH:
            found.append((m, a, stop, False))
    for k, (m, a, b, quoted) in enumerate(found):
        inner = found[k + 1][0].start() if k + 1 < len(found) else len(text)
        if inner <= a:
            continue
        if not quoted:
            if inner < b and text[inner - 1] in BETWEEN:
                b = inner
            before = text[m.start() - 1 : m.start()]
            if before and before in "\"'" and (end := text.find(before, a, b)) >= 0:
                b = end
            while b > a and text[b - 1] in AFTER:
                b -= 1
        if b - a >= LEAST_LENGTH:
            yield a, b, m["sign"] is not None


def is_name(value: str) -> bool:
    """Whether the value only names a secret, or is a link without a user, or one character throughout."""
    return len(set(value)) < 3 or PLACE.fullmatch(value) is not None or LINK.fullmatch(value) is not None


def spans_of(text: str, least: float, ranks: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and added spans as (start, kind, end), in that order."""
    base = []
    low = text.lower()
    cues = any(c in low for c in CUES)
    if cues:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    assigned = [s for s, _, _ in base]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    added = []
    if cues:
        for a, b, sign in contexts(text):
            k = bisect_right(assigned, a)
            if k < len(assigned):  # a further assignment
                b = min(b, assigned[k])
            while b > a and text[b - 1] in AFTER:
                b -= 1
            if b - a < LEAST_LENGTH or added and b <= added[-1][2]:
                continue
            k = bisect_left(starts, b)
            if k and reach[k - 1] > a:
                continue
            value = text[a:b]
            if (sign or not PROSE.fullmatch(value.rstrip(".!?:)"))) and not is_name(value) and guess_cost(value, ranks, least) >= least:
                added.append((a, 3, b))
    return base, added


def learn_words(docs: DataFrame, text_col: str, size: int) -> dict[str, int]:
    """Ranks of the words that most texts of the corpus have, at most ``size``, and of the fixed list, which comes first.

    All whole texts are counted; words of one count are in together or not at all. What stands in a credential context doesn't count, so a secret that thousands of copies
    hold doesn't become a word.
    """

    def count(found):
        seen: Counter = Counter()
        for b in found:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                low = _lower(text)
                if any(c in low for c in CUES):
                    parts, at = [], 0
                    for a, e, _ in contexts(text):
                        parts.append(low[at:a])
                        at = max(at, e)
                    low = " ".join([*parts, low[at:]])
                seen.update(set(LETTERS.findall(low)))
                if len(seen) > 500_000:
                    yield _words(seen)
                    seen.clear()
        yield _words(seen)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = Store(docs.sparkSession).keep(counted.where("n > 2"), "words")
    step = F.when(F.col("n") <= 1000, F.col("n")).otherwise(1000 + F.floor((F.log("n") - math.log(1000)) * 200)).cast("long")  # steps of half a percent above
    steps = sorted(((r.s, r.k) for r in counted.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)  # under 10,000 of them
    least, taken = math.inf, 0
    for s, k in steps:
        taken += k
        if taken > size:
            break
        least = s
    top = counted.where(step >= least).collect() if steps and least < math.inf else []  # at most ``size`` words of up to LONGEST letters
    top.sort(key=lambda r: (-r.n, r.word))
    ranks = dict(RANK)
    for r in top:
        ranks.setdefault(r.word, len(ranks) + 1)
    return ranks


def _words(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_guesses: float = 9.0, dictionary: int = DICTIONARY) -> DataFrame:
    """Secrets of every whole text: counts of the base kinds, digest of the base spans and all spans.

    Base spans are whole matches of the fixed patterns. The method adds spans of kind ``guess``: values in a wider
    credential context whose cheapest segmentation needs at least 10**least_guesses guesses and that meet no base span.
    Its dictionary is a fixed list and the ``dictionary`` words that most texts of ``docs`` have. Values that only name a
    secret (variables, templates, calls) and links without a user are left out; so are, where nothing but white space
    separates, values like ordinary words (letters in lower case, capitalised or in capitals throughout). Contexts may
    overlap: in "secret token: x" the value is x, and a value within a reported one isn't reported again. Offsets are in
    code points, ends exclusive.

    * Null text is an empty one: zero counts, digest of the empty string, no spans; so has a text without contexts.
    * Very long texts and values are read whole; a value's cost is found in time linear in it.
    * Rows are judged one by one, so repeated rows repeat their result. Spans of one start come in the order of KINDS.
    * An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_words(docs, text_col, dictionary))  # at most ``dictionary`` words

    def scan(found):
        ranks = shared.value
        for batch in found:
            rows = []
            for text in batch.column(1):
                base, added = spans_of(text.as_py() or "", least_guesses, ranks)
                kinds = [k for _, k, _ in base]
                name = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
                both = [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + added)]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(",".join(name).encode()).hexdigest(), ",".join(both), len(added)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
