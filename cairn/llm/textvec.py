"""Vectorised text primitives shared by the text operators of this subpackage.

Everything works on one Arrow batch at a time: all strings of the batch become one array of code points, and words, word
hashes and shingles are computed by array operations over it, never by a loop over characters or words.

Nulls count as empty texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, 65, dtype=np.uint64) * _STEP


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For each code point: is it a letter or a digit?"""
    table = np.zeros(0x110000, dtype=bool)
    table[:0x33480] = [chr(c).isalnum() for c in range(0x33480)]
    return table


@lru_cache(maxsize=1)
def _char_values() -> np.ndarray:
    return mix64(np.arange(1, 0x110001, dtype=np.uint64) * _STEP)


@lru_cache(maxsize=1)
def _powers(n: int = 4096) -> np.ndarray:
    """Odd multipliers by position in a word; longer words use them cyclically."""
    return mix64(np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def code_points(strings: list[str] | pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, one after another, and the offset of each string (one more offset than strings)."""
    if not isinstance(strings, (pa.Array, pa.ChunkedArray)):
        strings = pa.array(strings, pa.string())
    strings = pc.fill_null(strings, "")
    if lower:
        strings = pc.utf8_lower(strings)
    offsets = np.zeros(len(strings) + 1, dtype=np.int64)
    np.cumsum(pc.utf8_length(strings).to_numpy(zero_copy_only=False), out=offsets[1:])
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(strings)], pa.int64()), strings.cast(pa.large_string())), pa.scalar("", pa.large_string()))[0].as_py() if len(strings) else ""
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), offsets


class Words:
    """The words of a batch of strings: ``start``, ``end`` (code points, over the whole batch), ``row`` and a 64-bit ``hash`` of each."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        self.points, self.offsets = points, offsets
        inside = word_table()[points]
        # A word ends at a row's end even if the next row goes on with a letter.
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cut = offsets[1:-1]
        cut = cut[cut < len(points)]
        begin[cut] |= inside[cut]
        self.start = np.flatnonzero(begin)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        before = cut[cut > 0] - 1
        stop[before] |= inside[before]
        self.end = np.flatnonzero(stop) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        if hashed:
            self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(inside)
        length = self.end - self.start
        first = np.zeros(len(length), dtype=np.int64)
        np.cumsum(length[:-1], out=first[1:])
        place = np.arange(len(at), dtype=np.int64) - np.repeat(first, length)
        powers = _powers()
        values = _char_values()[self.points[at]] * powers[place & (len(powers) - 1)]
        return mix64(np.add.reduceat(values, first))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` consecutive words of one row. Rows of fewer words have none."""
    if len(words.hash) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    same = words.row[n - 1 :] == words.row[: len(words.row) - n + 1]
    at = np.flatnonzero(same)
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        value = mix64(value + words.hash[at + k] + _STEPS[k])
    return value, words.row[at]


def distinct_by_row(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending, and the offsets of the rows."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    offsets = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(np.bincount(row, minlength=rows), out=offsets[1:])
    return value, offsets
