"""Suffix-array dedup: exact repeated strings found with a run-length index (operator 10).

Each shard of routed text (repeats.py) gets a Burrows-Wheeler transform that is kept as runs: their symbols and first rows.
For both ends of each run the index samples how far the suffix that an LF step from there leads to agrees with its
neighbour in suffix order.  Strings are streamed through the index by backward search, all strings of the shard one step
at a time: inside a run a step makes both neighbours' matches one symbol longer, at its ends the samples tell.  That gives
the matching statistics of the shard against itself, and long matches are marked.  In repetitive shards runs are few.

Symbols are bytes, or words (64-bit hashes of them, numbered within the shard).
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, keyed, runs, utf8
from .repeats import MOST, merged, repeated_spans
from .words import words

#: Symbols of text in one index.
SHARD = 1 << 18


def suffix_order(key: np.ndarray, pack: int) -> np.ndarray:
    """Suffix array by prefix doubling from keys that hold ``pack`` symbols; only suffixes that still tie are sorted
    again."""
    n = len(key)
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    place = np.arange(n, dtype=np.int32)
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    at = order
    rank = np.zeros(n + 1, np.int32)  # a group's rank is its first place plus 1; 0 stands behind the text
    depth = pack
    while True:
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(place)))
        rank[at] = np.repeat(place[head] + 1, size)
        tied = np.repeat(size > 1, size)
        place, at = place[tied], at[tied]
        if not len(place):
            return order
        both = (rank[at].astype(np.int64) << 32) | rank[np.minimum(at + depth, n)]
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[place] = at
        new = np.ones(len(place), bool)
        new[1:] = both[1:] != both[:-1]
        depth *= 2


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several strings, with samples at both ends of its runs.

    heads: the symbol of each run; starts: its first row; leads: the row that an LF step leads to from there.  low and
    high: how many symbols the suffix an LF step leads to from a run's first (last) row shares with the one before
    (behind) it.  rows: the row of each string's end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.lengths = np.diff(offsets)
        m = len(self.lengths)
        n = len(data) + m
        bits = (int(data.max(initial=0)) + 1).bit_length()
        pack = 63 // bits
        text = np.zeros(n + pack, np.uint64)  # 0 ends each string
        text[np.arange(len(data)) + np.repeat(np.arange(m), self.lengths)] = data.astype(np.uint64) + np.uint64(1)
        self.begin = offsets[:-1] + np.arange(m)
        key = np.zeros(n, np.uint64)
        for i in range(pack):
            key = (key << np.uint64(bits)) | text[i : n + i]
        order = suffix_order(key, pack)
        before = text[order - 1]
        before[order == 0] = 0  # nothing stands before the first string
        self.starts = np.concatenate(([0], np.flatnonzero(before[1:] != before[:-1]) + 1))
        self.heads = before[self.starts]
        self.n = n
        size = np.diff(np.append(self.starts, n))
        by = np.argsort(self.heads, kind="stable")
        self.leads = np.zeros(len(by), np.int64)
        self.leads[by] = np.cumsum(size[by]) - size[by]
        inner = self.heads > 0
        self.low = self._sample(text, key, order, pack, self.leads, -1, inner)
        self.high = self._sample(text, key, order, pack, self.leads + size - 1, 1, inner)
        row = np.zeros(n, np.int64)
        row[order] = np.arange(n)
        self.rows = row[self.begin + self.lengths]

    @staticmethod
    def _sample(text: np.ndarray, key: np.ndarray, order: np.ndarray, pack: int, row: np.ndarray, way: int, use: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes in each row and in the one ``way`` from it."""
        n, out = len(key), np.zeros(len(row), np.int64)
        live = np.flatnonzero(use & (row + way >= 0) & (row + way < n))
        x, y = order[row[live]].astype(np.int64), order[row[live] + way].astype(np.int64)
        while len(live):
            same = (np.maximum(x, y) < n) & (key[np.minimum(x, n - 1)] == key[np.minimum(y, n - 1)])
            stop = ~same
            if stop.any():  # the last symbols one by one
                s, t, u = live[stop], x[stop], y[stop]
                going = np.ones(len(s), bool)
                for i in range(pack):
                    at, bt = np.minimum(t + i, n), np.minimum(u + i, n)
                    going &= (np.maximum(t, u) + i < n) & (text[at] == text[bt])
                    out[s] += going
            live, x, y = live[same], x[same] + pack, y[same] + pack
            out[live] += pack
        return out

    def stream(self):
        """Backward search of all strings, from their ends: (places, symbols less 1, matching statistics) of each step.

        A place's statistic says how far the string matches any other place from there on; matches end with the string.
        """
        by = np.argsort(-self.lengths, kind="stable")
        lengths, end, row = self.lengths[by], (self.begin + self.lengths)[by], self.rows[by]
        size = np.diff(np.append(self.starts, self.n))
        low = high = np.zeros(len(by), np.int64)
        live = len(by)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            while live and lengths[live - 1] < step:
                live -= 1
            row, low, high = row[:live], low[:live], high[:live]
            run = np.searchsorted(self.starts, row, side="right") - 1
            at = row - self.starts[run]
            low = np.minimum(np.where(at == 0, self.low[run], low + 1), step)
            high = np.minimum(np.where(at == size[run] - 1, self.high[run], high + 1), step)
            row = self.leads[run] + at
            yield end[:live] - step, self.heads[run] - np.uint64(1), np.maximum(low, high)

    def matching(self) -> np.ndarray:
        """Matching statistics of all places, ends of strings included (0)."""
        out = np.zeros(self.n, np.int64)
        for place, _, length in self.stream():
            out[place] = length
        return out

    def text(self) -> np.ndarray:
        """The symbols that the index holds, string after string."""
        out = np.zeros(self.n, np.uint64)
        for place, symbol, _ in self.stream():
            out[place] = symbol
        return out[self._inner()]

    def _inner(self) -> np.ndarray:
        keep = np.ones(self.n, bool)
        keep[self.begin + self.lengths] = False
        return keep


def mark(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` symbols from each symbol on occur elsewhere in the shard."""
    if data.dtype == np.uint64:
        data = np.unique(data, return_inverse=True)[1]
    index = RunLengthIndex(data, offsets)
    return (index.matching() >= length)[index._inner()]


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _remove(unit: str, texts: bool, carry: list[str]):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for part in batches:
            data, offsets = utf8(part.column("_text"))
            spans, raw = part.column("spans"), memoryview(data)
            rows = []
            for first, last in runs(offsets, 1 << 20):
                start, end, _, word = words(data, offsets[first : last + 1]) if unit == "words" else (None, None, None, None)
                for i in range(first, last):
                    lo, hi = merged(spans, i)
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    if unit == "words" and len(lo):  # from the first byte of a run's first word to the last of its last
                        lo, hi = start[word[i - first] + lo] - a, end[word[i - first] + hi - 1] - a
                    cuts = np.concatenate(([0], np.stack([lo, hi], 1).ravel(), [b - a])).tolist()
                    kept = b"".join(raw[a + x : a + y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                    rows.append((b - a, b - a - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            numbers = [pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *numbers, *(part.column(c) for c in carry)], [*names, *carry])

    return run


def suffix_array_dedup(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text", texts: bool = True, most: int = MOST, carry: Mapping[str, str] | None = None, unit: str = "bytes") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else in the corpus.

    With ``unit`` "words", strings are ``length`` consecutive words ``[^\\x20\\x09-\\x0D]+``; a removed run reaches from
    its first word's first byte to its last word's last, and white space around it stays.

    One row per input row: doc_id, n_bytes, n_removed (bytes), n_spans (maximal removed runs), kept_sha256 and, with
    ``texts``, the kept text (bytes of a character that was cut in two are left out there, not in the digest).  A null
    text counts as empty.  Rows that repeat an id or a whole text are documents of their own: copies of ``length`` symbols
    or more remove each other.  The columns in ``carry`` are passed on under the names it gives them, others are ignored.
    Strings are judged on the input, never across documents.
    """
    ws = Workspace(docs.sparkSession, "suffix-array")
    carry = carry or {}
    rows = keyed(docs, id_column, text_column, tuple(carry))
    spans = repeated_spans(rows, ws, unit, length, mark, SHARD, most)
    inner = [f"_{i}" for i in range(len(carry))]
    types = "".join(f", {n} {dict(docs.dtypes)[c]}" for n, c in zip(inner, carry, strict=True))
    out = rows.join(spans, "_key", "left").select("_id", "_text", "spans", *inner).mapInArrow(_remove(unit, texts, inner), OUT + types)
    return ws.keep(out.select(*[c for c in out.columns if c not in inner], *[F.col(n).alias(c) for n, c in zip(inner, carry.values(), strict=True)]))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_array_dedup(docs, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
