"""Vectorised work on the bytes of many texts at once, for use inside Arrow tasks.

A chunk is a run of texts as one byte array and their offsets. Chunks are cut by bytes, so
what a task holds is bounded by ``limit`` or by its longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix64(np.arange(1, 257, dtype=U)) | U(1)
LETTER = np.where(SPACE, U(0), BYTE)
BASE = U(0x9E3779B97F4A7C15)


def powers(n: int, base=BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, ends, body = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may span bytes
        size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
        if size.sum() != at[-1] - at[0]:
            return (yield from chunks(pa.array([x or b"" for x in column.to_pylist()], pa.large_binary()), limit))
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case (ASCII and Latin-1 letters) without ASCII punctuation."""
    if not len(data):
        return data, offsets
    out = data.copy()
    upper = (data >= 65) & (data <= 90)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    upper |= after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[upper] += 32
    mark = (data < 128) & (data > 32) & ~(((data >= 48) & (data <= 57)) | ((out >= 97) & (out <= 122)))
    mark |= data == 127
    left = np.concatenate(([0], np.cumsum(~mark)))
    return out[~mark], left[offsets]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    new = np.ones(len(data), bool)
    new[1:] = ~inside[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(new & inside)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    span = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, span)
    value = LETTER[data[starts[0] :]] * powers(int(span.max()))[place]
    return mix64(np.add.reduceat(value, starts - starts[0])), np.searchsorted(offsets, starts, "right") - 1


def shingles(word: np.ndarray, text: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word's place of every run of ``width`` words."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = powers(width)
    h = word[:n] * p[0]
    for j in range(1, width):
        h += word[j : n + j] * p[j]
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return mix64(h[at]), text[at], at


def segments(text: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` texts begins in a sorted array of text numbers, and its end."""
    return np.searchsorted(text, np.arange(n + 1))
