"""Substring dedup: exact repeated word sequences found with suffix automata (operator 2).

The corpus is its own reference.  Its shards are routed by content (repeats.py), so that a passage meets every shard
that can hold it, and only that one; each shard of bounded size becomes a suffix automaton, the documents' passages are
streamed through it for matching statistics, and spans above the threshold go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Workspace, batch, keyed, runs, utf8
from .repeats import MOST, merged, repeated_spans
from .words import words

#: Words in one automaton.
SHARD = 60_000


class SuffixAutomaton:
    """Suffix automaton of several word sequences: every state is a class of sequences with the same ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        step, link, length = self.next, self.link, self.length
        for number, sequence in enumerate(sequences):
            last = 0
            if number:
                sequence = [-number, *sequence]  # a symbol of its own keeps sequences apart
            for symbol in sequence:
                fresh = len(step)
                step.append({})
                length.append(length[last] + 1 if symbol >= 0 or last else 1)
                link.append(0)
                at = last
                while at >= 0 and symbol not in step[at]:
                    step[at][symbol] = fresh
                    at = link[at]
                if at >= 0:
                    to = step[at][symbol]
                    if length[at] + 1 == length[to]:
                        link[fresh] = to
                    else:
                        twin = len(step)
                        step.append(dict(step[to]))
                        length.append(length[at] + 1)
                        link.append(link[to])
                        while at >= 0 and step[at].get(symbol) == to:
                            step[at][symbol] = twin
                            at = link[at]
                        link[to] = link[fresh] = twin
                last = fresh
        self.repeated = np.zeros(len(step), bool)  # a state that others link to ends at two places at least
        self.repeated[np.array(link[1:], np.int64)] = True

    def matching(self, sequence: list[int], own: bool = False) -> list[int]:
        """Matching statistics: for each place, the length of the longest sequence that ends there and occurs in the
        shard; with ``own`` (the sequence is part of the shard) that occurs there at another place too."""
        step, link, length, repeated = self.next, self.link, self.length, self.repeated.tolist()
        state, have, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in step[state]:
                state = link[state]
                have = length[state]
            if symbol in step[state]:
                state = step[state][symbol]
                have += 1
            else:
                state = have = 0
            if own and state and not repeated[state]:
                out.append(length[link[state]])
            else:
                out.append(have)
        return out


def mark(hashes: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` words from each word on occur elsewhere in the shard."""
    _, symbol = np.unique(hashes, return_inverse=True)
    symbol = symbol.tolist()
    sequences = [symbol[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    automaton = SuffixAutomaton(sequences)
    out = np.zeros(len(hashes), bool)
    for begin, sequence in zip(offsets[:-1].tolist(), sequences, strict=True):
        ends = np.flatnonzero(np.array(automaton.matching(sequence, own=True)) >= length)
        out[begin + ends - length + 1] = True
    return out


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches):
        for part in batches:
            data, offsets = utf8(part.column("_text"))
            spans = part.column("spans")
            rows = []
            for a, b in runs(offsets, 1 << 20):
                start, end, _, first = words(data, offsets[a : b + 1])
                for i in range(a, b):
                    x, y = int(first[i - a]), int(first[i - a + 1])
                    lo, hi = merged(spans, i)
                    cuts = np.concatenate(([0], np.stack([lo, hi], 1).ravel(), [y - x])).tolist()
                    kept = []
                    for p, q in zip(cuts[::2], cuts[1::2], strict=True):
                        if q > p:
                            kept += bytes(data[start[x + p] : end[x + q - 1]]).split()
                    text = b" ".join(kept)
                    rows.append((y - x, y - x - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if texts else None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield batch(schema, doc_id=part.column("_id"), n_words=cols[0], n_removed=cols[1], kept_sha256=cols[2], kept=cols[3])

    return run


def substring_dedup(docs: DataFrame, length: int = 35, id_column: str = "doc_id", text_column: str = "text", texts: bool = True, most: int = MOST) -> DataFrame:
    """Remove every word covered by a window of ``length`` words whose sequence also starts anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  One row per input row: doc_id, n_words, n_removed, kept_sha256 (of
    the kept words joined by one space) and, with ``texts``, those words.  A null text has no words.  Rows that repeat an
    id or a whole text are documents of their own: copies of ``length`` words or more remove each other.  Other columns
    are ignored.  Windows are judged on the input, never across documents.
    """
    ws = Workspace(docs.sparkSession, "substring")
    rows = keyed(docs, id_column, text_column)
    spans = repeated_spans(rows, ws, "words", length, mark, SHARD, most)
    return ws.keep(rows.join(spans, "_key", "left").select("_id", "_text", "spans").mapInArrow(_remove(texts), OUT))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
