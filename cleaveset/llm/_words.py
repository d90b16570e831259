"""Vectorised words of Arrow text columns: 64-bit hashes over UTF-8 bytes, A-Z folded to a-z.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is ``[^\\x20\\x09-\\x0D]+`` on the text. Two words get
equal hashes if their bytes agree; different words collide with probability 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 1 << 64)
#: Bytes of text that are hashed at once; a worker holds some ten 64-bit numbers for each of them.
SLICE = 250_000


def _values() -> np.ndarray:
    table = np.random.RandomState(20240607).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    table[65:91] = table[97:123]
    table[SPACE] = 0
    return table


VALUES = _values()
_powers = {ODD: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below at least n."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if at else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row is alone in its range."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each row): row i has words ``[bounds[i], bounds[i + 1])``."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = ~SPACE[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = letter[heads]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    h = np.add.reduceat(VALUES[raw] * powers(ODD, len(raw))[: len(raw)], starts)
    return mix(h * powers(INVERSE, len(raw))[starts]), bounds


def batches(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, bounds) of slices of a text column."""
    raw, offsets = text_bytes(column)
    for a, b in slices(offsets, most):
        yield a, b, *words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n items from each position on (len(h) - n + 1 positions)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(ODD) + h[i : len(h) - n + 1 + i]
    return mix(out + np.uint64(n))
