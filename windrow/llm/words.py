"""Vectorised word and shingle hashes over the bytes of Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds a task's temporary arrays to a few tens of MB (a longer word is a part of its own).
PART_BYTES = 2_000_000
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What parts words where punctuation does not belong to them: all of ASCII but letters and digits.
MARKS = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_random = np.random.default_rng(0x5EED)
BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
GRAM = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (the finaliser that MurmurHash3 made common)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), STEP)]))


def _part(data: np.ndarray, firsts: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data and the places where they start; firsts: where texts start."""
    inside = ~apart[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = firsts[firsts < len(data)]
    start[at] = inside[at]
    places = np.flatnonzero(inside)
    if not len(places):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(start[places])
    lengths = np.diff(np.append(first, len(places)))
    within = np.arange(len(places)) - np.repeat(first, lengths)
    values = BYTES[LOWER[data[places]]] * _powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), places[first]


def hashed(texts: pa.Array, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's words start in them, with the end); null texts have none.

    Words are runs of bytes that are not set in apart (white space at first), A-Z lower-cased.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, starts, low = [], [], 0
    while low < len(data):
        high = min(low + PART_BYTES, len(data))
        while high < len(data) and not apart[data[high - 1]] and (end := _cut(data, offsets, high, apart)) != high:
            high = end
        inner = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        h, at = _part(data[low:high], inner, apart)
        hashes.append(h)
        starts.append(at + low)
        low = high
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(at, offsets)


def _cut(data: np.ndarray, offsets: np.ndarray, high: int, apart: np.ndarray) -> int:
    """The next place from high on where no word is cut: after a separator or where a text starts."""
    text = int(offsets[min(np.searchsorted(offsets, high), len(offsets) - 1)])
    width = 4096
    while high < text:
        spaces = np.flatnonzero(apart[data[high : min(high + width, text)]])
        if len(spaces):
            return high + int(spaces[0]) + 1
        high, width = min(high + width, text), width * 2
    return text


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n consecutive words, where each text's start in them): a text of fewer words, but not none, is one gram."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    total = int(starts[-1])
    at = np.arange(total) - np.repeat(starts[:-1], sizes) + np.repeat(bounds[:-1], sizes)
    end = np.repeat(bounds[1:], sizes)
    out = np.repeat(np.minimum(counts, n), sizes).astype(np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        out = out + np.where(at + k < end, padded[at + k], np.uint64(0)) * GRAM[k]
    return mix(out), starts


def each_set(h: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct hashes, in rising order."""
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield np.unique(h[low:high])
