"""Words and word shingles of UTF-8 texts, hashed in bulk.

A text's words are its runs of bytes other than space and 0x09 to 0x0D, with
A-Z in lower case. Words are hashed by differences of a running polynomial sum
modulo 2**64, so no Python object is made for a word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed together.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ROOT, -1, 1 << 64)
    up, down = (np.full(n, r, dtype=_U) for r in (_ROOT, inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, bounds)`` of runs of texts of about ``SLICE`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or wide else b"")
        yield from slices(texts)
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and how many words lie before each text (and at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, space[:-1]
    first = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    last = np.flatnonzero(~space & (after | edge[1:]))
    size = 1 << max(20, (n - 1).bit_length())
    up, down = _powers(size)
    running = np.cumsum((data.astype(_U) + _U(1)) * up[:n], dtype=_U)
    h = running[last] - np.where(first > 0, running[first - 1], _U(0))
    h = mix(h * down[first] + (last - first + 1).astype(_U) * _U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(first, bounds)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; a shorter text is one shingle, an empty one none."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = h[:len(h) - k + 1] + _U(k)
    for j in range(1, k):
        out = mix(out * _U(0x9FB21C651E98DF25) + h[j:len(h) - k + 1 + j])
    return mix(out)


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, bounds in slices(texts):
        h, at = words(data, bounds)
        for a, b in zip(at[:-1], at[1:]):
            yield np.unique(shingles(h[a:b], k))
