"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RANDOM = np.random.default_rng(0x5EED)
BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
PLACE = _RANDOM.integers(1, 2**63, 8, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SLICE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


_cached: dict[str, np.ndarray] = {"up": _powers(BASE, SLICE), "down": _powers(BASE_INVERSE, SLICE)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    return _cached[name][:n] if n <= SLICE else _powers(base, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (A-Z folded, parted by white space), and the words of each text."""
    n = len(data)
    gap = SPACE[data]
    start = ~gap
    start[1:] &= gap[:-1]
    end = ~gap
    end[:-1] &= gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = ~gap[inner]
    end[inner - 1] = ~gap[inner - 1]
    at, to = np.flatnonzero(start), np.flatnonzero(end)
    sums = np.cumsum(BYTE[FOLD[data]] * _power("up", BASE, n)) if n else np.zeros(0, np.uint64)
    before = np.where(at > 0, sums[at - 1], U(0)) if n else sums
    h = (sums[to] - before) * _power("down", BASE_INVERSE, n)[at] if n else sums
    return mixed(h + (to - at + 1).astype(np.uint64)), np.diff(np.searchsorted(at, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles, ascending, one text after the other, and their numbers. A text of fewer
    words has one shingle, all its words; a text without words has none."""
    words, n = word_hashes(data, offsets)
    texts = len(n)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(texts), n)
    whole = len(words) - k + 1
    h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole > 0:
        h = np.zeros(whole, np.uint64)
        for j in range(k):
            h += words[j : j + whole] * PLACE[j]
        same = owner[:whole] == owner[k - 1 :]
        h, of = mixed(h[same]), owner[:whole][same]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array([_short(words[first[t] : first[t] + n[t]]) for t in short], np.uint64)
        h, of = np.concatenate([h, extra]), np.concatenate([of, short])
    order = np.argsort(h)
    order = order[np.argsort(of[order], kind="stable")]
    h, of = h[order], of[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
    return h, np.bincount(of, minlength=texts)


def _short(words: np.ndarray) -> int:
    return int(mixed((words * PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) + U(len(words)))[0])


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a text column of about ``SLICE`` bytes, or one text: first, end, bytes, offsets. Nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column if pa.types.is_large_string(column.type) else column.cast(pa.string())
    column = column.fill_null("") if column.null_count else column
    # the text stays where it is: a copy of a whole batch would be held as long as its pieces are read
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        b = min(b, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
