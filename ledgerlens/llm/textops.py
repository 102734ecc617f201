"""Numpy helpers over Arrow string batches: words, word hashes, shingles.

A word is a maximal run of bytes other than space and 0x09-0x0D, found on
the UTF-8 bytes themselves (every separator is a single byte).  Hashes are
64-bit: a polynomial over the bytes, finished with an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20          # text hashed at once, so scratch arrays stay small
SHINGLE = 5
SHINGLE_BYTES = 1 << 18        # ... for shingles: scratch is about 30 times this

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Breaks that leave ASCII letters and digits (and all non-ASCII bytes) as words.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEP = U64(0x9E3779B97F4A7C15)
_BASE = U64(0x8F1BBCDC9A3C5D27)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finisher on uint64 (a bijection)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_PLACE = mix((np.arange(1, SHINGLE + 1, dtype=U64)) * _STEP) | U64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets (null: empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes (a longer text alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_hashes(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE,
                fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some rows, and each row's word range (n + 1)."""
    hashes, at, _ = located_words(raw, offsets, breaks, fold)
    return hashes, at


def located_words(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE,
                  fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each row's word range (n + 1) and each word's first byte
    (counted from the first row's start).

    ``breaks`` marks the separator bytes and ``fold`` maps bytes (case).
    """
    base = int(offsets[0])
    b = fold[raw[base:int(offsets[-1])]]
    at = offsets - base
    none = np.zeros(0, U64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    if not len(b):
        return none
    word = ~breaks[b]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]                  # a row's first byte starts a word
    start[first] = word[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return none
    inside = np.arange(len(b), dtype=np.int64)
    inside -= np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else \
        np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(b))))])
    powers = np.full(int(inside.max()) + 1, _BASE, dtype=U64)
    powers[0] = U64(1)
    powers = np.multiply.accumulate(powers)
    values = np.where(word, (b.astype(U64) + U64(1)) * powers[inside], U64(0))
    hashes = mix(np.add.reduceat(values, starts))
    return hashes, np.searchsorted(starts, at).astype(np.int64), starts


def shingle_hashes(words: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Hashes of the 5-word shingles of words[lo:hi], in order.

    Fewer words than five: the whole sequence is the one shingle; no word:
    no shingle.
    """
    n = hi - lo
    if n <= 0:
        return np.zeros(0, U64)
    k = min(n, SHINGLE)
    total = np.zeros(n - k + 1, U64)
    for j in range(k):
        total += words[lo + j:hi - k + 1 + j] * _PLACE[j]
    return mix(total + U64(k))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes of its whole text."""
    raw, offsets = text_bytes(column)
    for lo, hi in slices(offsets, SHINGLE_BYTES):
        words, at = word_hashes(raw, offsets[lo:hi + 1])
        for i in range(hi - lo):
            yield np.unique(shingle_hashes(words, int(at[i]), int(at[i + 1])))
