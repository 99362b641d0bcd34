"""Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts as arrays: places and 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np

from .windows import MIX2, mix, powers, prefix_hash, span_hash

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
    """Words (runs of bytes that aren't ``space``) of the documents that lie at ``offsets`` in ``data``.

    Returns (start, end, hash, first): byte places and hashes of all words, and for each document the index of its
    first word (one more at the end).  A word never crosses documents.
    """
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    at = offsets - base
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(at), np.int64)
    solid = ~space[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edge = at[1:-1][at[1:-1] < len(data)]
    start[edge] = solid[edge]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    edge = edge[edge > 0]
    end[edge - 1] = solid[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    sym = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    return s + base, e + base, span_hash(prefix_hash(sym), s, e), np.searchsorted(s, at)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5):
    """Hashes of runs of ``size`` words within documents; a shorter document gives its whole sequence as one.

    Returns (hash, first): all shingles in order, and each document's first (one more at the end).
    """
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    start = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    out = np.zeros(len(start), np.uint64)
    if len(start):
        short = np.repeat(count < size, n)
        full = np.flatnonzero(~short)
        factor = powers(size)
        for i in range(size):
            out[full] += hashes[start[full] + i] * factor[size - 1 - i]
        prefix = prefix_hash(hashes)
        few = np.flatnonzero(short)
        size_of = np.repeat(count, n)[few]
        out[few] = span_hash(prefix, start[few], start[few] + size_of) + size_of.astype(np.uint64) * MIX2
    return mix(out), begin
