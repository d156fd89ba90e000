"""Word and shingle hashes of whole Arrow text batches, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 2 << 20  # bytes hashed at once, so that temporaries stay small however long a text is
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_STEP = U(0x9E3779B97F4A7C15)
_ODD = _RNG.integers(1 << 62, 1 << 63, 5, dtype=np.uint64) | U(1)
_PAD = U(0x5851F42D4C957F2D)  # stands for a missing word of a text with fewer than a shingle has


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 (in place on a fresh array)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the offset of each row; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, at, data = array.buffers()
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(data: np.ndarray, offsets: np.ndarray, start: int) -> int:
    """Where a slice that begins at `start` may end without cutting a word."""
    end = start + SLICE
    if end >= len(data):
        return len(data)
    row_end = offsets[np.searchsorted(offsets, end, "right") - 1]
    if row_end > start:
        return int(row_end)
    while end < len(data):
        gaps = np.flatnonzero(_GAP[data[end : end + SLICE]])
        if len(gaps):
            return int(end + gaps[0])
        end += SLICE
    return len(data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each word, its length in bytes, and its hash with A-Z in lower case. Words never cross rows."""
    starts, lengths, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    inner = np.zeros(len(data) + 1, bool)
    inner[offsets] = True
    while at < len(data):
        end = _cut(data, offsets, at)
        part = data[at:end]
        solid = ~_GAP[part]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | inner[at + 1 : end]
        last[:-1] &= ~solid[1:] | inner[at + 1 : end]
        s = np.flatnonzero(first)
        if len(s):
            n = np.flatnonzero(last) - s + 1
            powers = np.multiply.accumulate(np.full(int(n.max()), _STEP, np.uint64))
            index = np.flatnonzero(solid)
            begin = np.concatenate(([0], np.cumsum(n)[:-1]))
            place = np.arange(len(index), dtype=np.int64) - np.repeat(begin, n)
            h = np.add.reduceat(_BYTE[part[index]] * powers[place], begin)
            starts.append(s + at)
            lengths.append(n)
            hashes.append(mix(h ^ (n.astype(np.uint64) * _STEP)))
        at = end
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(hashes)


def shingle_sets(array: pa.Array, size: int = 4):
    """Yield, for each row, its sorted distinct shingle hashes (63 bits, as int64).

    A shingle is `size` (at most 5) words in a row; a text with fewer words is one shingle, one without words has none.
    """
    data, offsets = buffers(array)
    starts, _, hashes = words(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        w = hashes[lo:hi]
        if not len(w):
            yield np.empty(0, np.int64)
            continue
        if len(w) < size:
            w = np.concatenate((w, np.full(size - len(w), _PAD, np.uint64)))
        n = len(w) - size + 1
        h = w[:n] * _ODD[0]
        for j in range(1, size):
            h = (h ^ (h >> U(29))) * _STEP + w[j : n + j] * _ODD[j]
        yield np.unique(mix(h) >> U(1)).view(np.int64)
