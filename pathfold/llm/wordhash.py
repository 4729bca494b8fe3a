"""Words and n-grams of whole texts as 64-bit hashes, by array operations.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A
word's hash is a polynomial in an odd base modulo 2^64, finished by a mixing function; it
depends on the word alone. Long texts are handled in pieces cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Also every other ASCII character that is neither letter nor digit.
PUNCTUATION = SPACE | np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        step = np.full(max(n, PIECE + 1), base, np.uint64)
        step[0] = 1
        _POWERS[base] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _piece(raw: np.ndarray, first: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    space = table[raw]
    start = ~space
    start[1:] &= space[:-1] | first[1:]
    end = ~space
    end[:-1] &= space[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    if most:
        e = np.minimum(e, s + most)
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], out=total[1:])
    h = (total[e] - total[s]) * _powers(_INVERSE, n + 1)[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), s


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row where its words begin (n + 1 values).

    table: which bytes stand between words; most: hash only so many first bytes of each.
    """
    hashes, starts, at = [], [], 0
    while at < len(raw):
        to = min(at + PIECE, len(raw))
        if to < len(raw):
            reach = 256
            while to > at and to < len(raw):  # cut where a word ends
                gap = np.flatnonzero(table[raw[max(at, to - reach) : to]])
                if len(gap):
                    to = max(at, to - reach) + int(gap[-1]) + 1
                    break
                if to - reach <= at:
                    gap = np.flatnonzero(table[raw[to : to + PIECE]])
                    to = to + int(gap[0]) + 1 if len(gap) else min(to + PIECE, len(raw))
                    if len(gap):
                        break
                    continue
                reach *= 16
        first = np.zeros(to - at, bool)
        here = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        first[here] = True
        h, s = _piece(raw[at:to], first, table, most)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; len(h) - n + 1 values, rows not regarded."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g *= _GRAM
        g += h[k : len(h) - n + 1 + k]
    return mix(g + np.uint64(n))


def blocks(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes (at least one row): from, to, bytes, offsets."""
    raw, offsets = flat(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
