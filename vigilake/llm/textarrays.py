"""UTF-8 texts of an Arrow batch as numpy arrays: words, word hashes, windows of words.

Everything works on whole texts, a slice of rows at a time; a slice holds about ``SLICE`` bytes, or
one text if that is longer, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: digits, letters after lower-casing A-Z, and every byte of a non-ASCII character
LETTERS = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: powers that a worker keeps; those of longer texts are made anew, so that one long text does not stay in memory
_KEPT = SLICE + 4096
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        full = np.full(max(n, _KEPT), _BASE if which == "up" else _INVERSE, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= _KEPT:
            _powers[which] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows' texts in them); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: runs of bytes of a kind, cut at the ends of texts."""
    inside = kind[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[filled] = False
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    after[ends] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; the hash of data[i:j] follows from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _power("down", len(prefix))[start])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), start, end)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; one per start, windows may cross texts (the caller masks those)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            total += hashes[j:j + count] * factor
            factor = np.uint64(factor * _STEP)
        return mix(total + np.uint64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set.

    Words are runs of non-space bytes after lower-casing A-Z.
    """
    low = LOWER[data]
    start, end, row = words(low, offsets, NOT_SPACE)
    hashes = word_hashes(low, start, end)
    windows = window_hashes(hashes, k)
    bounds = np.searchsorted(row, np.arange(len(offsets)), "left")
    out = []
    for i in range(len(offsets) - 1):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if hi - lo >= k:
            out.append(np.unique(windows[lo:hi - k + 1]))
        else:
            out.append(window_hashes(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out
