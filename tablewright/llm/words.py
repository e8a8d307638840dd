"""64-bit hashes of words and word shingles (five words by default) for whole Arrow columns of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
_SEGMENT = 1 << 20  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15
_COUNT = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        step = np.full(n, _BASE, np.uint64)
        back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        have = np.cumprod(step), np.cumprod(back)
        if n <= 4 * _SEGMENT:
            _POWERS[0] = have
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and the offsets of its rows in them."""
    texts = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def word_spans(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the offsets of the rows in the words."""
    inside = np.concatenate([[False], ~_SPACES[raw], [False]])
    change = inside[1:] != inside[:-1]
    at_rows = np.zeros(len(raw) + 1, bool)
    at_rows[rows] = True
    starts = np.flatnonzero((change | at_rows) & inside[1:])
    ends = np.flatnonzero((change | at_rows) & inside[:-1])
    return starts, ends, np.searchsorted(starts, rows)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each word's bytes, A-Z lower-cased."""
    if lower:
        raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT)))
        first = int(starts[i])
        part = raw[first : int(ends[j - 1])]
        step, back = _powers(max(len(part) + 1, _SEGMENT + 1))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * step[: len(part)], out=sums[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64) * _COUNT)
        i = j
    return out


def shingles(words: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words of each row, repeats included, and the rows' offsets
    in them. A row of fewer words has its whole sequence as one; a row without words has none."""
    counts = np.diff(rows)
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(counts)), sizes)
    first = rows[:-1][owner] + np.arange(offsets[-1]) - offsets[:-1][owner]
    total = np.minimum(counts, size)[owner].astype(np.uint64) * _COUNT
    odd = _BASE
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    last = rows[1:][owner]
    for k in range(size):
        total = total + np.where(first + k < last, padded[first + k], np.uint64(0)) * np.uint64(odd)
        odd = (odd * odd + 2 * k + 2) % (1 << 64)
    return mix(total), offsets


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, rows = utf8(column)
    starts, ends, bounds = word_spans(raw, rows)
    hashes, offsets = shingles(word_hashes(raw, starts, ends), bounds, size)
    return [_distinct(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def _distinct(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]
