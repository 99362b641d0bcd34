"""Content-defined routing of fixed-length windows, shared by the two exact repeat removers.

A *window* is ``length`` consecutive symbols (bytes or words) of one document.  Two equal windows must meet in one
task although nobody knows where they are.  Every window picks its smallest ``gram``-gram (by hash, leftmost on ties),
a choice that depends on the window's content alone, so equal windows pick equal grams.  Consecutive windows of a
document that picked the same gram form a *group*: one row ``(anchor hash, digest of the symbols the group spans,
place)`` stands for about ``length / 2`` windows, and every window is in exactly one group.

Everything here is numpy over one bounded block of symbols; Spark partitions and shuffles the rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers of the polynomial and of the finalisers.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
#: Symbols handled at once.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = np.uint64(pow(int(BASE), -1, 1 << 64)) if inverse else BASE
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n of the base or of its inverse modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    return _powers(size, inverse)[: n + 1]


def prefix_hash(sym: np.ndarray) -> np.ndarray:
    """S[i] = sum of sym[j] * BASE**j for j < i."""
    out = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(sym * powers(len(sym))[: len(sym)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the symbols in [start, end) that doesn't depend on their place."""
    inv = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * MIX2)


def gram_hash(sym: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` symbols: by doubling for a power of two, else from prefixes."""
    if gram & (gram - 1):
        place = np.arange(max(0, len(sym) - gram + 1))
        return span_hash(prefix_hash(sym), place, place + gram)
    h, width = sym, 1
    while width < gram:
        factor = powers(width)[width]
        h = h[:-width] * factor + h[width:]
        width *= 2
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def groups(sym: np.ndarray, piece_start: np.ndarray, piece_end: np.ndarray, length: int, gram: int, salt: int = 0):
    """Groups of the windows of several pieces that lie one after the other in ``sym``.

    Returns arrays (start in sym, number of windows, anchor hash, digest); no window crosses a piece.  Another ``salt``
    gives another choice of grams.  With a gram as long as a window each window is a group of its own.
    """
    empty = np.zeros(0, np.int64)
    if len(sym) < length:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    h = gram_hash(sym, gram)
    if salt:
        h = mix(h + mix(np.array([salt], np.uint64)))
    keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(keyed, length - gram + 1) & _PLACE).astype(np.int64)
    has = piece_end - piece_start >= length
    inside = np.zeros(len(sym) + 1, np.int32)  # +1 at a piece's first window, -1 behind its last
    np.add.at(inside, piece_start[has], 1)
    np.add.at(inside, piece_end[has] - length + 1, -1)
    valid = np.cumsum(inside)[: len(anchor)] > 0
    first = np.ones(len(anchor), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    first[piece_start[has]] = True
    places = np.flatnonzero(first & valid)
    if not len(places):
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    stop = np.flatnonzero(first | ~valid)
    nxt = np.append(stop, len(anchor))[np.searchsorted(stop, places, side="right")]
    count = nxt - places
    digest = span_hash(prefix_hash(sym), places, nxt + length - 1)
    return places, count, h[anchor[places]], digest


def blocks(sizes: np.ndarray, length: int, block: int = BLOCK):
    """Cut documents of the given sizes into lists of pieces (document, start, end) of about ``block`` symbols.

    A document longer than a block is cut into pieces that overlap by length - 1, so that each window is in one piece.
    """
    todo, held = [], 0
    for doc, size in enumerate(sizes.tolist()):
        at = 0
        while size - at >= length:
            end = min(size, at + block)
            if held + end - at > block and todo:
                yield todo
                todo, held = [], 0
            todo.append((doc, at, end))
            held += end - at
            if end == size:
                break
            at = end - length + 1
    if todo:
        yield todo


def spans_union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open spans; spans that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]
