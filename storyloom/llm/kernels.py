"""Vectorised word and shingle hashing over the UTF-8 buffers of Arrow string columns.

A block is a run of whole rows of at most ``BLOCK_BYTES`` together (a longer row is a block of its own), so the
numpy temporaries stay small whatever the size of an Arrow batch. Every row is processed to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
U64 = np.uint64

_rng = np.random.default_rng(20240501)
#: Random words by (byte, position in the word modulo 64).
_BYTE_AT = _rng.integers(0, 2**64, 256 * 64, dtype=U64)
#: Odd multipliers by place in a shingle.
_PLACE = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)

#: Bytes of words in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = np.array([b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(256)])
#: Bytes of words in ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets (one more than rows); nulls become empty rows."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most ``most`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of a block: their 64-bit hashes, byte spans in the block, and the first word of each row."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # rows + 1 entries: row r has the words first[r] .. first[r + 1]


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of ``kept`` bytes in every row. ``data``: the block's bytes; ``offsets``: its rows, from 0."""
    if lower:
        data = LOWER[data]
    inside = kept[data]
    n = len(data)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    edges = offsets[:-1]
    before[edges] = False  # a row's first byte follows nothing
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[edges] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    lengths = ends - starts
    if not len(starts):
        return Words(np.zeros(0, U64), starts, ends, np.zeros(len(offsets), np.int64))
    begins = np.cumsum(lengths) - lengths
    chars = data[inside].astype(np.int64)
    at = np.arange(len(chars)) - np.repeat(begins, lengths)
    values = _BYTE_AT[(chars << 6) | (at & 63)]
    if lengths.max() > 64:
        far = np.flatnonzero(at >= 64)  # mixed with their block of 64, so that blocks that trade bytes don't cancel
        values[far] = mix(values[far] + (at[far] >> 6).astype(U64) * _PLACE[0])
    hashes = mix(np.add.reduceat(values, begins) + lengths.astype(U64))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets).astype(np.int64))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(w: Words, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at i + p for p in ``places``, and the i of each; only where all lie in i's row."""
    span, n = max(places) + 1, len(w.hashes)
    if n < span:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    rows = row_of(w.first)
    at = np.flatnonzero(rows[: n - span + 1] == rows[span - 1 :])
    total = np.zeros(n - span + 1, U64)
    for k, p in enumerate(places):
        total += w.hashes[p : n - span + 1 + p] * _PLACE[k % 64]
    return mix(total[at]), at


def shingle_rows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in text order, and the rows' offsets.

    A row of 1 to k - 1 words has one shingle of them all; a row without words has none.
    """
    h, at = grams(w, tuple(range(k)))
    counts = np.diff(w.first)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if not ((counts > 0) & (counts < k)).any():
        return h, offsets
    out = np.zeros(offsets[-1], U64)
    rows = row_of(w.first)[at]
    starts_in_h = np.concatenate([[0], np.cumsum(np.where(counts >= k, sizes, 0))])
    out[offsets[rows] + np.arange(len(h)) - starts_in_h[rows]] = h
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        own = w.hashes[w.first[r] : w.first[r + 1]]
        out[offsets[r]] = mix(np.array([(own * _PLACE[: len(own)]).sum(dtype=U64) ^ U64(len(own))]))[0]
    return out, offsets
