"""Hierarchical multi-length packing of token sequences (operator 3).

A document's tokens fill whole windows first.  What is left of it is routed to the shortest context-size tier that holds
it: the window, a half, a quarter, an eighth or a sixteenth of it.  Each tier is packed into windows of its own size, the
longest tier first: its longest piece opens a window, whose gap is filled from the shorter tiers, the longest piece that
fits first.  A gap that no piece fits is closed by cutting one.  Pieces that no longer tier has used up by then open
windows of their own tier.  Some pieces always wait for the gaps of the partition's next documents; at the partition's end
the last ones become sequences of powers of two, so nothing is padded.

Windows of a tier are dealt into step groups: equal tokens in all groups of all tiers, nearly equal attention work within a
tier.  Packing needs no shuffle: every partition packs what it has read, so the work and the padding don't depend on skew.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import default_path, ranked, text_slices
from .common import batch

#: Windows of the longest tier that a step group holds; of shorter tiers as many as have the same tokens.
GROUP = 8
#: Windows' tokens that wait for gaps, and step groups of a tier that are balanced against each other.
WAIT, TOGETHER = 16, 4

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: A piece that waits: (length, number, doc_id, start, ids as bytes, doc_tokens)
Piece = tuple[int, int, int, int, bytes, int]


def tiers(window: int) -> list[int]:
    """Context sizes: powers of two from the window down to a sixteenth of it."""
    return [window >> i for i in range(5)]


class Packer:
    """Packs pieces into windows of the tiers' sizes; memory is bounded by the pieces that wait."""

    def __init__(self, window: int):
        self.sizes = tiers(window)
        self.pool: list[list[Piece]] = [[] for _ in self.sizes]
        self.number = 0
        self.waiting = 0
        self.full: dict[int, list[list[Piece]]] = {}

    def tier(self, length: int) -> int:
        """The shortest tier that holds a piece."""
        return max(i for i, size in enumerate(self.sizes) if i == 0 or length <= size)

    def put(self, doc: int, ids: bytes) -> None:
        n, at, window = len(ids) // 4, 0, self.sizes[0]
        while n - at >= window:
            self._done(window, [(window, 0, doc, at, ids[4 * at : 4 * (at + window)], n)])
            at += window
        if at < n:
            self._wait(doc, at, ids[4 * at :], n)
        while self.waiting > WAIT * window:
            self._open()

    def _done(self, size: int, sequence: list[Piece]) -> None:
        self.full.setdefault(size, []).append(sequence)

    def _wait(self, doc: int, start: int, ids: bytes, total: int) -> None:
        self.number += 1
        length = len(ids) // 4
        insort(self.pool[self.tier(length)], (length, self.number, doc, start, ids, total))
        self.waiting += length

    def _take(self, tier: int, at: int) -> Piece:
        piece = self.pool[tier].pop(at)
        self.waiting -= piece[0]
        return piece

    def _fitting(self, gap: int) -> Piece | None:
        """The longest waiting piece of at most ``gap`` tokens."""
        for tier in range(self.tier(gap), len(self.sizes)):
            if at := bisect_right(self.pool[tier], (gap, 1 << 62)):
                return self._take(tier, at - 1)
        return None

    def _open(self) -> None:
        """Pack a window of the longest tier that has a piece; of the last tokens, one of a power of two."""
        size = gap = min(self.sizes[min(i for i, pool in enumerate(self.pool) if pool)], 1 << (self.waiting.bit_length() - 1))
        out = []
        while gap:
            piece = self._fitting(gap)
            if piece is None:  # every waiting piece is longer than the gap: cut the shortest, its rest waits
                tier = max(i for i, pool in enumerate(self.pool) if pool)
                _, number, doc, start, ids, total = self._take(tier, 0)
                piece = (gap, number, doc, start, ids[: 4 * gap], total)
                self._wait(doc, start + gap, ids[4 * gap :], total)
            out.append(piece)
            gap -= piece[0]
        self._done(size, out)

    def close(self) -> None:
        while self.waiting:
            self._open()

    def groups(self, last: bool = False) -> Iterator[list[list[Piece]]]:
        """Step groups of windows that are packed, the largest possible number of full ones together; in the end all."""
        for size, sequences in self.full.items():
            each = GROUP * self.sizes[0] // size
            while len(sequences) >= TOGETHER * each or (last and sequences):
                part, self.full[size] = sequences[: TOGETHER * each], sequences[TOGETHER * each :]
                sequences = self.full[size]
                number = step_groups(part, each)
                for group in range(max(number) + 1):
                    yield [s for s, g in zip(part, number, strict=True) if g == group]


def step_groups(sequences: list[list[Piece]], each: int = GROUP) -> list[int]:
    """A group for each sequence, ``each`` to a group: sequences by attention work, dealt out to and fro."""
    work = np.array([sum(p[0] ** 2 for p in s) for s in sequences])
    groups = -(-len(sequences) // each)
    order = np.argsort(-work, kind="stable")
    out = np.zeros(len(sequences), np.int64)
    for turn, begin in enumerate(range(0, len(sequences), groups)):
        part = order[begin : begin + groups]
        out[part] = np.arange(len(part)) if turn % 2 == 0 else groups - 1 - np.arange(len(part))
    return out.tolist()


def pack_documents(docs: DataFrame, window: int = 1024, end_id: int = 0, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens (a power of two).

    A document is its ids and ``end_id``; a null text counts as empty, so it is that one id.  One row per piece: doc_id,
    start, length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, and the sequence's
    tier (its length) and step_group (the first sequence of it).  Each id lies in one piece.  Every sequence is full or a power of two long, so
    nothing is padded.  Repeated rows are packed each on its own; other columns are ignored.
    """
    if window < 16 or window & (window - 1):
        raise ValueError("window must be a power of two, 16 at least")
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        bpe, packer = ranked(path), Packer(window)
        partition = TaskContext.get().partitionId() << 36
        done = 0

        def rows(groups):
            nonlocal done
            out = []
            for group in groups:
                first = partition + done
                for sequence in group:
                    total, at = sum(p[0] for p in sequence), 0
                    for length, _, doc, start, ids, tokens in sequence:
                        out.append((doc, start, length, zlib.crc32(ids), tokens, partition + done, at, total, first))
                        at += length
                    done += 1
            if out:
                yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

        for part in batches:
            ids = part.column(0).to_pylist()
            at = 0
            for texts in text_slices(part.column(1)):
                for doc, packed in zip(ids[at : at + len(texts)], bpe.encode(texts), strict=True):
                    packer.put(doc, packed + end)
                at += len(texts)
                yield from rows(packer.groups())
        packer.close()
        yield from rows(packer.groups(last=True))

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")).mapInArrow(run, PIECE)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
