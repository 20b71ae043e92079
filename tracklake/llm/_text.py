"""Vectorised word hashing over Arrow text columns, shared by the operators of this subpackage.

A column is cut into slices of about ``SLICE_BYTES`` of UTF-8 (one longer text makes a slice of its own), so
memory in a task is bounded by that figure or by the longest text, never by the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes that end a word of ``[^\x20\x09-\x0D]+``.
BLANK = _table((0x20, 0x20), (0x09, 0x0D))
#: Bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows."""
    data, off = text_bytes(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, i + 4096, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@dataclass
class Words:
    """Words of a slice in order: row of each, byte range, 64-bit hash; ``first`` holds n + 1 word offsets by row."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs of ``inside`` that don't cross a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    begin[cut] = inside[cut]
    stop[cut - 1] = inside[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each range as 64-bit numbers, the last one filled up with zeros; each number's place in its range, and n + 1 offsets of the ranges."""
    count = (end - start + 7) >> 3
    first = np.zeros(len(start) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    place = np.arange(first[-1]) - np.repeat(first[:-1], count)
    at = np.repeat(start, count) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    over = np.maximum(at + 8 - np.repeat(end, count), 0).astype(np.uint64) * np.uint64(8)
    return (value << over) >> over, place, first


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes give equal hashes.

    Every eight bytes are mixed together with their place before they are summed, so no regular text is a special case.
    """
    value, place, first = lanes(data, start, end)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value + mix(place.astype(np.uint64) * _STEP + np.uint64(1))), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + (end - start).astype(np.uint64) * _STEP)


def same_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each byte range equals the one whose number stands in ``other``."""
    if not np.array_equal(end - start, (end - start)[other]):
        return False
    value, place, first = lanes(data, start, end)
    return np.array_equal(value, value[np.repeat(first[:-1][other], np.diff(first)) + place])


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    start, end = runs(~separator[data], off)
    row = np.searchsorted(off, start, side="right") - 1
    first = np.zeros(len(off), np.int64)
    np.cumsum(np.bincount(row, minlength=len(off) - 1), out=first[1:])
    return Words(row, start, end, range_hashes(data, start, end), first)


def windows(w: Words, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First words of the n-word windows inside one row (out of ``at`` if given), and their hashes."""
    if at is None:
        at = np.arange(max(0, len(w.row) - n + 1))
    else:
        at = at[at + n <= len(w.row)]
    at = at[w.row[at] == w.row[at + n - 1]]
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * _Q + w.hash[at + k]
    return at, mix(out)


def sequence_hash(values: np.ndarray) -> np.uint64:
    """Hash of a short word sequence, by another rule than the one for windows."""
    out = np.uint64(len(values))
    with np.errstate(over="ignore"):
        for v in values:
            out = out * _Q + v + np.uint64(0x1234567)
    return mix(np.array([out], np.uint64))[0]
