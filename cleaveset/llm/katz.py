"""Katz backoff language model: Good-Turing discounted n-grams over discounted unigrams, exactly normalised.

Texts become chunks: the distinct word hashes of some thousand documents, and the documents as positions among them.
Order by order, chunks ask for what they can't know alone, packed by hash range of the history, and a range's task adds
the counts of all chunks and answers each one: the count of every n-gram asked for, and the sums that a history's backoff
weight needs. A history that no other chunk has is settled in its own. What is exchanged follows the
distinct n-grams of a chunk, and a word that is a third of all tokens is one entry a chunk. n-grams of histories that
would fill several ranges are spread over as many by their last word; a chunk then adds the sums of all of them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleaveset.llm._exchange import PARTITIONS
from cleaveset.llm._memory import keeping
from cleaveset.llm._store import Store
from cleaveset.llm._words import batches, mix

ORDER = 3
END = np.uint64(0x656E64)  # hash of the end token; words have mixed hashes
START = np.uint64((1 << 32) - 1)  # key of the history of a first token
CUT = 5  # counts above it aren't discounted
TYPES = (np.uint8, np.uint16, np.uint32, np.uint64)
ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(raw: bytes) -> bytes:
    """zstd, with the length before it."""
    return len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def expand(b: bytes) -> bytes:
    return ZSTD.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), asbytes=True) if len(b) > 8 else b""


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest type that holds them, byte by byte of their places, compressed."""
    top = int(x.max()) if len(x) else 0
    for t, kind in enumerate(TYPES):
        if top <= np.iinfo(kind).max:
            return bytes([t]) + squeeze(x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes())
    raise OverflowError(top)


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(TYPES[b[0]])
    planes = np.frombuffer(expand(b[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.uint64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..CUT + 1 from counts of counts n[1..CUT + 1]: Katz's form of Good-Turing.

    Where the counts of counts can't carry it (a ratio outside 0..1), absolute discounting by n1 / (n1 + 2 n2) takes
    over, which also keeps mass for the unseen.
    """
    d = np.ones(CUT + 2)
    d[0] = 0.0
    n = n.astype(float)
    if n[1] <= 0:
        return d
    top = (CUT + 1) * n[CUT + 1] / n[1]
    for r in range(1, CUT + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else -1.0
        d[r] = (ratio - top) / (1 - top) if top < 1 else -1.0
    if not all(0 < x < 1 for x in d[1 : CUT + 1]):
        less = min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2])))
        for r in range(1, CUT + 1):
            d[r] = (r - less) / r
    return d


class Unigrams:
    """P(w) by count: discounted relative frequencies, and the rest for one unknown outcome."""

    def __init__(self, n: np.ndarray, total: int):
        self.d, self.total = discounts(n), total
        kept = sum((1 - self.d[r]) * r * n[r] for r in range(1, CUT + 1))
        self.scale = total if kept > 0 else total + 1
        self.unknown = kept / total if kept > 0 else 1.0 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c == 0, self.unknown, self.d[np.minimum(c, CUT + 1)] * c / max(self.scale, 1))


def in_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of whole numbers; with their places beside them in 64 bits they sort several times as fast."""
    bits = max(1, len(x) - 1).bit_length()
    if len(x) and int(x.max()) >> (64 - bits):
        return np.argsort(x, kind="stable")
    packed = np.sort(x.astype(np.uint64) << np.uint64(bits) | np.arange(len(x), dtype=np.uint64))
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct numbers in order, first place of each, number of each place's): np.unique with both indexes."""
    order = in_order(x)
    value = x[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = value[1:] != value[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(fresh) - 1
    return value[fresh], order[fresh], at


def chunks(docs: DataFrame, id_col: str, text_col: str, held, tokens: int) -> DataFrame:
    """Rows of kind 0, the documents of a chunk as positions among its words, and of kind 1, those words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def flush(ids: list, held: list, seq: list, sizes: list) -> list[pa.RecordBatch]:
        with keeping():
            size = np.concatenate(sizes)
            hold = np.concatenate(held)
            words, _, at = grouped(np.concatenate(seq))
            rank = np.empty(len(words), np.int64)  # the sequence names frequent words by small numbers, which compress well
            by = np.argsort(-np.bincount(at), kind="stable")
            rank[by] = np.arange(len(words))
            counts, spare = (np.bincount(at[np.repeat(m, size)], minlength=len(words)) for m in (~hold, hold))
            whole = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            blob = lambda x: pa.array([x], pa.binary())
            name = uuid.uuid4().int >> 66  # a table is written from these rows before anything reads them, so the name is fixed
            none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), whole.slice(0, 0))
            number = lambda x: pa.array([x], pa.int64())
            names = ["kind", "chunk", "ids", "held", "sizes", "seq", "by", "words", "counts", "spare", "n_words", "n_tokens"]
            text = [lists, blob(np.packbits(hold).tobytes()), blob(pack(size)), blob(pack(rank[at])), blob(pack(by)), blob(b""), blob(b""), blob(b"")]
            voc = [none, blob(b""), blob(b""), blob(b""), blob(b""), blob(pack_sorted(words)), blob(pack(counts)), blob(pack(spare))]
            return [pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), number(name), *columns, number(len(words) * (1 - k)), number(len(at) * (1 - k))], names) for k, columns in enumerate((text, voc))]

    def run(found):
        ids, hold, seq, sizes, n = [], [], [], [], 0
        for b in found:
            flags = np.array(b.column(1).to_numpy(zero_copy_only=False), bool)
            for a, e, h, bounds in batches(b.column(2)):
                size = np.diff(bounds) + 1
                ids.append(b.column(0).slice(a, e - a))
                hold.append(flags[a:e])
                seq.append(np.insert(h, bounds[1:], END))
                sizes.append(size)
                n += int(size.sum())
                if n >= tokens:
                    yield from flush(ids, hold, seq, sizes)
                    ids, hold, seq, sizes, n = [], [], [], [], 0
        if n:
            yield from flush(ids, hold, seq, sizes)

    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"kind int, chunk long, ids array<{kind}>, held binary, sizes binary, seq binary, by binary, words binary, counts binary, spare binary, n_words long, n_tokens long")


REPLY = "kind int, chunk long, range int, a binary, b binary, c binary, d binary, e binary"
NAMES = ["kind", "chunk", "range", "a", "b", "c", "d", "e"]


def _reply(rows: list[tuple]) -> pa.Table:
    """Rows of (kind, chunk, range, a, ...); missing blobs are empty."""
    rows = [(*r, *[b""] * (8 - len(r))) for r in rows]
    columns = list(zip(*rows)) if rows else [()] * 8
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5))], NAMES)


def _word_counts(table: DataFrame, ranges: int) -> DataFrame:
    """Replies of kind 0 (count, id and held-out count of each distinct word of a chunk) and of kind 9 (totals of a range)."""
    width = (1 << 64) // ranges + 1
    edges = (np.arange(1, ranges, dtype=object) * width).astype(np.uint64)

    def split(found):
        for b in found:
            for k in range(b.num_rows):
                words, *counts = unpack_sorted(b.column(1)[k].as_py()), unpack(b.column(2)[k].as_py()), unpack(b.column(3)[k].as_py())
                cut = np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])
                some = [r for r in range(ranges) if cut[r] < cut[r + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([b.column(0)[k].as_py()] * len(some), pa.int64()), pa.array([pack_sorted(words[cut[r] : cut[r + 1]]) for r in some], pa.binary()), *(pa.array([pack(x[cut[r] : cut[r + 1]]) for r in some], pa.binary()) for x in counts)], ["range", "chunk", "words", "counts", "spare"])

    def count(t: pa.Table) -> pa.Table:
        with keeping():
            r = t["range"][0].as_py()
            words = [unpack_sorted(x.as_py()) for x in t["words"]]
            u, _, at = grouped(np.concatenate(words))
            total, spare = (np.bincount(at, np.concatenate([unpack(x.as_py()) for x in t[c]]).astype(float), len(u)).astype(np.int64) for c in ("counts", "spare"))
            cut = np.cumsum([0, *map(len, words)])
            rank = np.empty(len(u), np.uint64)  # frequent words have small ids, which compress well
            rank[np.argsort(-total, kind="stable")] = np.arange(len(u), dtype=np.uint64)
            out = [(0, c.as_py(), r, pack(total[at[cut[k] : cut[k + 1]]]), pack(rank[at[cut[k] : cut[k + 1]]] * np.uint64(ranges) + np.uint64(r)), pack(spare[at[cut[k] : cut[k + 1]]])) for k, c in enumerate(t["chunk"])]
            stats = np.concatenate([[total.sum(), (total > 0).sum()], np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3), [len(u)]])
            return _reply([*out, (9, -1, r, stats.astype(np.int64).tobytes())])

    asked = table.select("chunk", "words", "counts", "spare").mapInArrow(split, "range int, chunk long, words binary, counts binary, spare binary")
    return asked.repartition(min(ranges, PARTITIONS), "range").groupBy("range").applyInArrow(count, REPLY)


def spread(count: np.ndarray, total: int, ranges: int) -> np.ndarray:
    """Over how many ranges the n-grams of a history go: one for each average range's worth of its tokens."""
    return np.maximum(np.uint64(1), count.astype(np.uint64) * np.uint64(ranges) // np.uint64(max(total, 1)))


def range_of(key: np.ndarray, sub: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(key + sub * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(ranges)).astype(np.int64)


def sums_of(h: np.ndarray, n: np.ndarray, lower: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each history: n-grams of count 1..CUT and tokens of those above it; and the lower order's P of all seen words."""
    out = np.zeros((size, CUT + 1))
    for r in range(1, CUT + 1):
        out[:, r - 1] = np.bincount(h[n == r], minlength=size)
    out[:, CUT] = np.bincount(h, np.where(n > CUT, n, 0), size)
    return out, np.bincount(h, np.where(n > 0, lower, 0.0), size).astype(float)  # of no n-grams it counts in whole numbers


class Model:
    """What all tasks know: training tokens, training documents, ranges, and the discounts of the orders so far."""

    def __init__(self, unigrams: Unigrams, total: int, ranges: int):
        self.unigrams, self.total, self.ranges = unigrams, total, ranges
        self.d: list[np.ndarray] = []  # of bigrams, trigrams, ...

    def _with(self, d: list[np.ndarray]) -> Model:
        self.d = d
        return self

    def lower(self, order: int, m: np.ndarray, den: np.ndarray) -> np.ndarray:
        """P of one order less, of n-grams that training has, from their count and their history's."""
        if order == 2:
            return self.unigrams.p(m)
        d = self.d[order - 3]
        return d[np.minimum(m, CUT + 1).astype(np.int64)] * m / den


class Level:
    """The n-grams of one order in a chunk, by number: their histories, counts and, once answered, probabilities."""

    def __init__(self, hist: np.ndarray, key: np.ndarray, count: np.ndarray, spare: np.ndarray, word: np.ndarray, ids: np.ndarray, trained: np.ndarray, m: np.ndarray, den: np.ndarray, model: Model):
        self.key, self.count, self.model = key, count.astype(np.int64), model
        gram, token, self.at = grouped(hist * len(ids) + word)
        self.h, self.w = gram // len(ids), gram % len(ids)
        self.id = ids[self.w]
        self.token = token  # one of each n-gram's tokens
        self.m, self.den = m[token], np.ones(len(key))
        self.den[self.h] = den[token]
        self.own, self.other = (np.bincount(self.at[x], minlength=len(gram)) for x in (trained, ~trained))
        here = np.bincount(self.h, self.own + self.other, len(key))
        self.open = (here > 0) & (self.count > 0) & (here != self.count + spare.astype(np.int64))  # others have it, too
        parts = spread(self.count, model.total, model.ranges)
        self.hot = parts > 1
        self.asked = np.flatnonzero(self.open[self.h])
        r = range_of(key[self.h[self.asked]], mix(self.id[self.asked]) % parts[self.h[self.asked]], model.ranges)
        by = in_order(r)
        self.asked, self.r = self.asked[by], r[by]
        one = np.flatnonzero(self.open)
        each = np.repeat(one, parts[one].astype(np.int64))
        sub = np.arange(len(each)) - np.repeat(np.cumsum(parts[one].astype(np.int64)) - parts[one].astype(np.int64), parts[one].astype(np.int64))
        at = range_of(key[each], sub.astype(np.uint64), model.ranges)
        code = np.sort(at * len(key) + each)
        code = code[np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]])]  # two parts of a history may fall in one range
        self.entry, self.entry_r = code % len(key), code // len(key)
        self.size = np.bincount(np.searchsorted(code, self.r * len(key) + self.h[self.asked]), minlength=len(code))

    def asks(self, chunk: int) -> list[tuple]:
        """(range, chunk, histories, whether spread, their denominators, n-grams of each, words, own counts, held-out ones, lower counts)."""
        cut = np.searchsorted(self.r, np.arange(self.model.ranges + 1))
        place = np.searchsorted(self.entry_r, np.arange(self.model.ranges + 1))
        out = []
        for r in np.flatnonzero(place[1:] > place[:-1]):
            e, g = self.entry[place[r] : place[r + 1]], self.asked[cut[r] : cut[r + 1]]
            blobs = (self.key[e], self.hot[e], self.den[e].astype(np.uint64), self.size[place[r] : place[r + 1]], self.id[g], self.own[g], self.other[g], self.m[g])
            out.append((int(r), chunk, *(pack(x) for x in blobs)))
        closed = self.own[~self.open[self.h]]
        seen = np.bincount(np.minimum(closed[closed > 0], CUT + 2), minlength=CUT + 3).astype(np.int64)
        return [*out, (-1, chunk, seen.tobytes(), *[b""] * 7)]

    def answer(self, order: int, replies: list[dict]) -> None:
        """Take in the counts and sums of the open histories; those of the others are the chunk's own."""
        self.n, self.spare = self.own.copy(), self.other.copy()
        lower = self.model.lower(order, self.m, self.den[self.h])
        mine = ~self.open[self.h]
        self.sums, self.seen = sums_of(self.h[mine], self.own[mine], lower[mine], len(self.key))
        replies = sorted(replies, key=lambda x: x["range"])
        if replies:
            self.n[self.asked] = np.concatenate([unpack(x["a"]) for x in replies]).astype(np.int64)
            self.spare[self.asked] = np.concatenate([unpack(x["e"]) for x in replies]).astype(np.int64)
            some = np.concatenate([unpack(x["b"]) for x in replies]) > 0
            need = needed(self.hot[self.entry], self.size, self.n[self.asked])  # with an n-gram to back off, or spread
            mask = some & ~need
            self.sums[self.entry[mask], 0] += 1  # not spread, so one entry each
            full, more = self.entry[need], np.concatenate([unpack(x["c"]).astype(float).reshape(-1, CUT + 1) for x in replies])
            mass = np.concatenate([np.frombuffer(expand(x["d"])) for x in replies])
            once = ~self.hot[full]
            self.sums[full[once]] += more[once]
            self.seen[full[once]] += mass[once]
            np.add.at(self.sums, full[~once], more[~once])
            np.add.at(self.seen, full[~once], mass[~once])

    def probabilities(self, order: int, below: np.ndarray) -> np.ndarray:
        """log10 P of each n-gram; ``below`` is that of one order less, by token."""
        d = self.model.d[order - 2]
        less = d[1 : CUT + 1] < 1
        self.full = self.sums[:, :CUT] @ less.astype(float) == 0  # nothing is discounted: one more token is set aside
        count = self.count.astype(float)
        seen = (self.sums[:, :CUT] @ (d[1 : CUT + 1] * np.arange(1, CUT + 1)) + self.sums[:, CUT]) / np.maximum(count, 1)
        left = np.where(self.full, 1.0 / (count + 1), 1.0 - seen)
        weight = np.where(self.count > 0, left / np.maximum(1.0 - self.seen, 1e-300), 1.0)
        back = np.log10(np.maximum(weight, 1e-300))[self.h] + below[self.token]
        self.total = np.where(self.full, count + 1, np.maximum(count, 1))
        del self.sums, self.seen, seen, left, weight
        direct = d[np.minimum(self.n, CUT + 1)] * self.n / self.total[self.h]
        return np.where(self.n > 0, np.log10(np.where(self.n > 0, direct, 1.0)), back)


def needed(hot: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    lacks = np.bincount(np.repeat(np.arange(len(size)), size)[n == 0], minlength=len(size)) > 0
    return lacks | hot


def _joined(key: np.ndarray, word: np.ndarray, narrow: bool) -> np.ndarray:
    """Keys of n-grams as histories: two numbers below 2 ** 32 side by side, else a 64-bit hash."""
    return key << np.uint64(32) | word if narrow else mix(mix(key) * np.uint64(0x9E3779B97F4A7C15) + word)


class Chunk:
    """A chunk with the replies that it has: the words, and the levels as far as they are answered."""

    def __init__(self, row: dict, replies: list[dict], model: Model, narrow: bool, orders: int):
        own = sorted((x["range"], x["a"], x["b"], x["c"]) for x in replies if x["kind"] == 0)
        self.c, ids, spare = (np.concatenate([unpack(x[j]) for x in own]) for j in (1, 2, 3))
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.seq = unpack(row["by"]).astype(np.int64)[unpack(row["seq"]).astype(np.int64)]
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(self.sizes)).astype(bool)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        trained = ~self.held[self.row]
        start = np.cumsum(self.sizes) - self.sizes
        end = self.seq[-1]  # the last token is an end token; each document has one
        own_spare = spare
        key, count, gram = ids, self.c, self.seq
        self.value = np.log10(np.maximum(model.unigrams.p(self.c), 1e-300))[self.seq]
        m, den = self.c[self.seq], np.ones(len(self.seq))
        for order in range(2, orders + 1):
            hist = np.concatenate([[0], gram[:-1]])
            hist[start] = len(key)
            level = Level(hist, np.append(key, START), np.append(count, self.c[end]), np.append(spare, own_spare[end]), self.seq, ids, trained, m, den, model)
            self.level, gram = level, level.at
            if order - 2 == len(model.d):  # not answered yet
                break
            level.answer(order, [x for x in replies if x["kind"] == order])
            self.value = level.probabilities(order, self.value)[gram]
            if order == orders:
                break
            key, count = _joined(level.key[level.h], level.id, narrow and order == 2), level.n
            spare = level.spare
            m, den = level.n[gram], level.total[level.h][gram]


ASK = "range int, chunk long, hist binary, hot binary, den binary, size binary, w binary, n binary, o binary, m binary"


def _ngrams(table: DataFrame, replies: DataFrame, model, order: int, narrow: bool, chunks: int, ranges: int) -> DataFrame:
    """Replies of kind ``order`` to the chunks, and counts of counts by range (kind 100 + order)."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        with keeping():
            names = [x.split()[0] for x in ASK.split(", ")]
            rows = []
            if left.num_rows:
                rows = Chunk(left.to_pylist()[0], right.to_pylist(), model.value, narrow, order).level.asks(left["chunk"][0].as_py())
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 8))], names)

    def count(t: pa.Table) -> pa.Table:
        with keeping():
            r = t["range"][0].as_py()
            if r < 0:
                seen = sum(np.frombuffer(x, np.int64) for x in t["hist"].to_pylist())
                return _reply([(100 + order, -1, r, seen.tobytes())])
            part = {k: [unpack(x) for x in t[k].to_pylist()] for k in ("hist", "hot", "den", "size", "w", "n", "o", "m")}
            flat = {k: np.concatenate(v) for k, v in part.items()}
            histories, _, hi = grouped(flat["hist"])
            entry = np.repeat(np.arange(len(hi)), flat["size"].astype(np.int64))
            followers, _, wi = grouped(flat["w"])
            _, first, at = grouped(hi[entry] * max(1, len(followers)) + wi)
            n, spare = (np.bincount(at, flat[x].astype(float), len(first)).astype(np.int64) for x in ("n", "o"))
            lower = model.value.lower(order, flat["m"][first].astype(np.int64), flat["den"][entry[first]].astype(float))
            sums, seen = sums_of(hi[entry[first]], n, lower, len(histories))
            out, e, g = [], 0, 0
            for k, c in enumerate(t["chunk"].to_pylist()):
                f, i = e + len(part["hist"][k]), g + len(part["w"][k])
                mine, h = n[at[g:i]], hi[e:f]
                need = needed(part["hot"][k] > 0, part["size"][k].astype(np.int64), mine)
                out.append((order, c, r, pack(mine), pack(sums[h, :CUT].sum(1) > 0), pack(sums[h[need]].astype(np.uint64).ravel()), squeeze(seen[h[need]].tobytes()), pack(spare[at[g:i]])))
                e, g = f, i
            stats = np.bincount(np.minimum(n[n > 0], CUT + 2), minlength=CUT + 3).astype(np.int64)
            return _reply([*out, (100 + order, -1, r, stats.tobytes())])

    both = (x.repartition(chunks, "chunk").groupBy("chunk") for x in (table, replies))
    asked = next(both).cogroup(next(both)).applyInArrow(ask, ASK)
    return asked.repartition(min(ranges, PARTITIONS), "range").groupBy("range").applyInArrow(count, REPLY)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, order: int = ORDER, chunk_tokens: int = 1_250_000, range_entries: int = 600_000) -> DataFrame:
    """Base and Katz log10 probabilities of every whole text; rows with crc32(id as text) mod modulus = remainder are held out of training.

    The model backs off from ``order`` (at least 2) down to single words, recursively for each token: an n-gram that
    training has takes its discounted relative frequency, another one the history's backoff weight times the probability
    of one order less; a history that training lacks passes it on unchanged.

    * A null or empty text is one end token. A row with a null id isn't held out. Repeated rows count and are scored each.
    * Words that training lacks share the probability of one unknown outcome. Without training rows every outcome is
      unknown and scores 0. Where counts of counts can't carry Good-Turing, absolute discounting takes over.
    * Very long texts are taken whole; a text of more than ``chunk_tokens`` words is a chunk of its own.
    * Words are told by 64-bit hashes. Histories are told exactly up to order 3 and 2 ** 32 distinct words, beyond by
      64-bit hashes.
    * An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    sc = docs.sparkSession.sparkContext
    store = Store(docs.sparkSession)
    held = (F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus).eqNullSafe(remainder)
    kind = docs.schema[id_col].dataType.simpleString()
    both = store.keep(chunks(docs, id_col, text_col, held, chunk_tokens), "chunks", partition="kind")
    table = both.where("kind = 0").select("chunk", "held", "sizes", "seq", "by")
    size = both.where("kind = 0").agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t"), F.count("*").alias("c")).first()
    words = max(2, -(-(size.w or 0) // (2 * range_entries)))
    ranges = max(2, -(-(size.t or 0) // range_entries))
    parts = min(max(1, size.c), PARTITIONS)
    had = store.keep(_word_counts(both.where("kind = 1"), words), "words", partition="kind").select(*NAMES)
    store.drop("chunks/kind=1")
    stats, most = np.zeros(CUT + 5, np.int64), 0
    for r in had.where("kind = 9").select("a").toLocalIterator():  # 88 bytes a range
        found = np.frombuffer(bytes(r.a), np.int64)
        stats, most = stats + found[:-1], max(most, int(found[-1]))
    total, distinct = int(stats[0]), int(stats[1])
    model = Model(Unigrams(stats[2:][: CUT + 2], total), total, ranges)
    narrow = most * words < int(START)  # ids are below the distinct words of the fullest range times the ranges
    had = had.where("kind = 0")
    for k in range(2, order + 1):
        replies = store.keep(_ngrams(table, had, sc.broadcast(model), k, narrow, parts, ranges), f"replies-{k}", partition="kind").select(*NAMES)
        seen = np.zeros(CUT + 3, np.int64)
        for r in replies.where(f"kind = {100 + k}").select("a").toLocalIterator():  # 64 bytes a range
            seen += np.frombuffer(bytes(r.a), np.int64)
        model = Model(model.unigrams, total, ranges)._with([*model.d, discounts(seen[: CUT + 2])])
        had = had.unionByName(replies.where(f"kind = {k}"))
    final = sc.broadcast(model)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        with keeping():
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            if not left.num_rows:
                return pa.table([pa.array([], t) for t in (left.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
            c = Chunk(left.to_pylist()[0], right.to_pylist(), final.value, narrow, order)
            known = c.c[c.seq]
            base = np.log10((known + np.uint64(1)).astype(float) / (total + distinct + 1.0))
            rows = len(c.sizes)
            ids = left["ids"].combine_chunks()
            ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
            add = lambda x: np.bincount(c.row, x, rows)
            return pa.table([ids, pa.array(c.held), pa.array(c.sizes), pa.array(add(known > 0).astype(np.int64)), pa.array(np.full(rows, total)), pa.array(add(base)), pa.array(add(c.value))], names)

    with_ids = both.where("kind = 0").select("chunk", "ids", "held", "sizes", "seq", "by")
    sides = (x.repartition(parts, "chunk").groupBy("chunk") for x in (with_ids, had))
    return next(sides).cogroup(next(sides)).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
