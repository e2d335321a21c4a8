"""Vectorised words, shingles and lines over the UTF-8 bytes of Arrow string columns.

Everything here works on one Arrow batch inside a Spark task.  A batch is cut
into slices of about one megabyte of text (a longer text is a slice of its own),
so memory depends on the longest text and not on the batch.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; all of these are
ASCII, so cutting UTF-8 bytes cuts the text at the same places.  A piece of text
is identified by a 64-bit hash of its bytes, positions and length; pieces are compared
within one text or between the two texts of a pair, where two different ones
agree with a chance of about (pieces of both texts)**2 / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POSITION = mix64(np.arange(1000, 1064, dtype=U64) * U64(_MULT)) | U64(1)


def _random(place: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each ``256 * position + byte``."""
    return mix64(place.astype(U64) * U64(_MULT) + U64(_INV))


_TABLED = 64  # positions whose numbers are looked up; those of later ones are computed
_TABLE = _random(np.arange(256 * _TABLED))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of bytes outside ``gap``, cut at row ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gap[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty piece ``data[start:end]``: the sum of a random number for each (position, byte).

    Unlike a polynomial modulo 2**64 the sum has no strings that collide by their structure;
    two different pieces agree with a chance of 2**-64.
    """
    if not len(starts):
        return np.zeros(0, U64)
    length = ends - starts
    begin = np.cumsum(length) - length
    position = np.arange(length.sum()) - np.repeat(begin, length)
    place = (position << 8) | data[position + np.repeat(starts, length)]
    late = np.flatnonzero(position >= _TABLED)
    if len(late):
        rest = place[late]
        place[late] = 0
    numbers = _TABLE[place]
    if len(late):
        numbers[late] = _random(rest)
    return mix64(np.add.reduceat(numbers, begin) + length.astype(U64) * U64(_INV))


def windows(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``k`` words inside a row, in text order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for j in range(k):
        total += words[j : j + n] * _POSITION[j]
    whole = row[:n] == row[k - 1 :]
    return mix64(total[whole] + U64(k)), row[:n][whole]


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``k``-word shingles of each row as (row, hash), sorted by both.

    A-Z count as a-z.  A row with fewer than ``k`` words has its whole sequence
    as one shingle, which no longer row shares; a row without words has none.
    """
    data = LOWER[data]
    starts, ends, row = runs(data, offsets, SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    words = hashes(data, starts, ends)
    found, at = windows(words, row, k)
    count = np.bincount(row, minlength=len(offsets) - 1)
    few = count[row] < k
    if few.any():
        short, of = words[few], row[few]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(begin, np.diff(np.r_[begin, len(of)]))
        sums = np.add.reduceat(short * _POSITION[place], begin)
        found = np.r_[found, mix64(sums + (count[of[begin]] + 1000).astype(U64))]
        at = np.r_[at, of[begin]]
    order = np.lexsort((found, at))
    found, at = found[order], at[order]
    keep = np.r_[True, (found[1:] != found[:-1]) | (at[1:] != at[:-1])]
    return at[keep], found[keep]


def per_row(at: np.ndarray, rows: int) -> np.ndarray:
    """Offsets (rows + 1) of the entries of each row in ``at``, which is sorted."""
    return np.searchsorted(at, np.arange(rows + 1))
