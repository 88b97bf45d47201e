"""Vectorised words of whole text columns: byte tables and prefix hashes in numpy.

A word is a run of bytes other than U+0020 and U+0009 to U+000D; A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import row_slices, text_buffers

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20_240_229)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE = _CODE[_LOWER]
# Another reading of a text, for spelling variants: letters, digits and bytes over 127 only.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_P, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD, byte_codes: np.ndarray = _BYTE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hash and start of each word of some rows."""
    n = len(data)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_codes[data] * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return rows, h, starts


def byte_codes(replaced: dict[int, int]) -> np.ndarray:
    """Codes under which some bytes (after lower-casing) count as others."""
    table = _LOWER.copy()
    for source, target in replaced.items():
        table[source] = target
    return _CODE[table]


def words(
    column: pa.Array, is_word: np.ndarray = IS_WORD, codes: np.ndarray = _BYTE
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each word counted from the first, hash of each word)."""
    data, offsets = text_buffers(column)
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * SLICE_BYTES or hi - lo > 1:
            rows, h, _ = _hashes(data[a:b], offsets[lo : hi + 1] - a, is_word, codes)
        else:  # one very long text: cut at separators, so that no word is split
            found = []
            while a < b:
                cut = min(a + SLICE_BYTES, b)
                while cut < b:
                    gaps = np.flatnonzero(~is_word[data[a:cut]])
                    if len(gaps):
                        cut = a + int(gaps[-1]) + 1
                        break
                    cut = min(cut + SLICE_BYTES, b)
                found.append(_hashes(data[a:cut], np.array([0, cut - a]), is_word, codes)[1])
                a = cut
            h = np.concatenate(found)
            rows = np.zeros(len(h), np.int64)
        yield lo, hi, rows, h


def shingles(rows: np.ndarray, h: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of ``size`` words, sorted by row and hash.

    A row of fewer words has its whole sequence as its one shingle; a row of none has none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    short = (counts > 0) & (counts < size)
    n = len(h)
    if n == 0:
        return rows[:0], h[:0]
    total = np.zeros(n, np.uint64)
    ends = np.repeat(np.cumsum(counts), counts)  # of each word's row
    for k in range(size):
        later = np.arange(k, n + k)
        there = later < ends
        step = np.zeros(n, np.uint64)
        step[there] = h[later[there]]
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + step)
    begins = ends - np.repeat(counts, counts)
    at = np.arange(n)
    whole = at + size <= ends
    keep = whole | (short[rows] & (at == begins))
    row, value = rows[keep], total[keep]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]
