"""Words, shingles and their 64-bit hashes over whole Arrow columns, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """Integers from 0 on as planes of bytes, the least first, as many as the largest needs."""
    planes = (int(values.max(initial=0)).bit_length() + 7) // 8
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        full[:, : len(planes)] = planes.T
    return full.view("<u8").ravel()


def steps(values: np.ndarray) -> bytes:
    """Unsigned integers in order, packed by what each adds to the one before."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def unsteps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n), dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each row; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of text, so that working arrays stay small."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        group = offsets[:-1] // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of several rows: byte ranges, hash of each, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray  # rows + 1 indexes into the words
    hashes: np.ndarray


def _letter_codes(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mixed(codes)


# Bytes that belong to words: all but the six white-space bytes, and letters and digits only.
SPACED = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ALNUM = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def words(column: pa.Array, lower: bool = True, inside_of: np.ndarray = SPACED) -> Words:
    """Words of each row, by default ``[^\\x20\\x09-\\x0D]+``; equal words have equal hashes."""
    data, offsets = text_bytes(column)
    size = len(data)
    inside = np.zeros(size + 1, bool)
    inside[:size] = inside_of[data]
    begins = inside[:size].copy()
    begins[1:] &= ~inside[: size - 1] if size else begins[1:]
    edges = offsets[:-1][offsets[:-1] < size]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    gap_or_start = ~inside
    gap_or_start[edges] = True
    stops = np.flatnonzero(gap_or_start)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    lengths = ends - starts
    longest = int(lengths.max()) if len(lengths) else 0
    powers = np.cumprod(np.full(longest + 1, 0x2545F4914F6CDD1D, np.uint64))
    at = np.cumsum(lengths) - lengths
    letters = np.flatnonzero(inside[:size])
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    parts = _letter_codes(lower)[data[letters]] * powers[place]
    hashes = mixed(np.add.reduceat(parts, at)) if len(starts) else np.zeros(0, np.uint64)
    return Words(starts, ends, np.searchsorted(offsets, starts, side="right") - 1, np.searchsorted(starts, offsets), hashes)


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words and its row; a shorter row is one run as a whole.

    Runs stand in the order of their first word.
    """
    n = len(found.hashes)
    weights = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.diff(found.first)
    left = found.first[1:][found.row] - np.arange(n)  # words from here to the row's end
    total = np.zeros(n, np.uint64)
    for j in range(k):
        shifted = np.zeros(n, np.uint64)
        if n > j:
            shifted[: n - j] = found.hashes[j:] * weights[j]
        total += np.where(left > j, shifted, np.uint64(0))
    length = np.minimum(left, k).astype(np.uint64)
    whole = (left >= k) | ((counts[found.row] < k) & (left == counts[found.row]))
    keep = np.flatnonzero(whole)
    return mixed(total[keep] + length[keep] * _STEP), found.row[keep]
