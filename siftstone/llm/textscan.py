"""Vectorised scanning of Arrow text columns: words and 64-bit word fingerprints without Python strings.

Everything works on the UTF-8 bytes of a whole Arrow batch with numpy.  A word's fingerprint is a polynomial
over its bytes modulo 2**64 (one prefix sum gives every word of a piece), finished with an avalanche step, so
it does not depend on where the word stands.  Texts are cut into pieces at separators, which bounds the
working memory for any text length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bytes scanned at once; working arrays take about 40 times as much.
PIECE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective avalanche step on 64-bit words (the finaliser of a public-domain mixing function)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.lru_cache(maxsize=2)
def _byte_values(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold_case:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a row border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | border[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """64-bit fingerprints of the byte spans; A-Z count as a-z if fold_case."""
    out = np.empty(len(starts), np.uint64)
    values, first = _byte_values(fold_case), 0
    while first < len(starts):
        low = starts[first]
        last = max(int(np.searchsorted(ends, low + PIECE, "right")), first + 1)
        high = ends[last - 1]
        size = int(high - low)
        up, down = _powers(PIECE if size <= PIECE else 1 << (size - 1).bit_length())
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[:size], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, A-Z lower-cased, and the row offsets into them."""
    data, offsets = text_bytes(column)
    starts, ends = spans(~_SPACE[data], offsets)
    return fingerprints(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the runs of ``size`` words of one text; a shorter text is one shingle, no words are none."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - size + 1 + k])
    return h


def parts(batch: pa.RecordBatch, text: int, size: int = 1 << 18):  # noqa: ANN201
    """Slices of a batch with about ``size`` bytes of text each, one row at least."""
    column = batch.column(text)
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first = 0
    while first < len(column):
        last = max(int(np.searchsorted(at, at[first] + size, "right")) - 1, first + 1)
        yield batch.slice(first, last - first)
        first = last
