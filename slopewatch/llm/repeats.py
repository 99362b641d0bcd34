"""Exact search for windows that occur more than once in a corpus, for bytes and for words.

1. Each document gives its window groups (windows.py): one small row for about half a window's length of text.
2. Rows are counted by anchor, and by anchor and digest, with partial aggregation before each shuffle.  An anchor that
   occurs once has no repeat.  A group whose digest occurs twice is a repeat as a whole.  Only groups whose anchor occurs
   with several digests need a look at their symbols, one representative for each digest.
3. The symbols of these representatives are fetched by one join and dealt out by anchor.  A task joins whole anchors
   into a shard of bounded size, builds the operator's index over it and marks the repeated windows.
4. An anchor with more than ``most`` different groups would not fit one shard: a gram that very many different texts
   share.  The windows of these groups choose again, by a longer gram and another hash, and the new groups go the same way
   from step 2 on.  Grams are doubled at first; from half the window on, what a window can choose from shrinks to a
   quarter each time, so an old group becomes a few new ones.  At the last level a gram is the whole window, so every
   window finds its equals.  Nothing is dropped, and no task holds more than a shard.

A window lies in exactly one group, so a window that occurs twice in a shard occurs at two places of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batch, by_key, runs, utf8
from .windows import blocks, gram_hash, groups, mix, prefix_hash, span_hash, spans_union
from .words import words

GROUP = "_key long, start int, n int, anchor long, digest long, times int"
SEGMENT = "anchor long, _key long, start int, size int, single boolean, hot boolean, symbols binary"
AGAIN = "anchor long, _key long, start int, n int, digest long, want boolean, symbols binary"
SPAN = "_key long, start int, end int"


def byte_symbols(data: np.ndarray, offsets: np.ndarray):
    return data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1), offsets - offsets[0]


def word_symbols(data: np.ndarray, offsets: np.ndarray):
    _, _, hashes, first = words(data, offsets)
    return hashes, first


UNITS = {"bytes": (byte_symbols, 32), "words": (word_symbols, 4)}
#: Bytes of text handled at once.
STEP = 1 << 20
#: Different groups of one anchor that an index takes; more are grouped anew.
MOST = 1024


def grams(unit: str, length: int) -> list[int]:
    """Gram lengths of the levels: powers of two from the unit's on, then such that a window has a quarter of the choices it
    had before, then the whole window.  So windows meet in few groups up to the last level, where each is one."""
    if length < 2:
        raise ValueError("windows must have two symbols at least")
    first = min(UNITS[unit][1], 1 << (length.bit_length() - 1))
    out = []
    while first < length:
        out.append(first)
        first = 2 * first if 2 * first < length else length - (length - first) // 4
    return [*out, length]


def find_groups(unit: str, length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (_key, _text) to the window groups of each document.

    A group that a document holds several times is one row, its first place, with how often it is there; the stretches
    that such groups cover are known to repeat and come as rows without an anchor, n symbols from start.  So a line that
    fills a document costs a few rows.
    """
    symbols, gram = UNITS[unit][0], grams(unit, length)[0]
    schema = pa.schema([("_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("digest", pa.int64()), ("times", pa.int32())])

    def run(batches):
        for part in batches:
            data, offsets = utf8(part.column("_text"))
            key = part.column("_key").to_numpy()
            for a, b in runs(offsets, STEP):
                sym, first = symbols(data, offsets[a : b + 1])
                for pieces in blocks(np.diff(first), length):
                    doc, lo, hi = (np.array(x) for x in zip(*pieces, strict=True))
                    whole = np.concatenate([sym[first[d] + x : first[d] + y] for d, x, y in pieces])
                    end = np.cumsum(hi - lo)
                    begin = end - (hi - lo)
                    place, n, anchor, digest = groups(whole, begin, end, length, gram)
                    if not len(place):
                        continue
                    at = np.searchsorted(end, place, side="right")
                    _, one, which, times = np.unique(mix(digest ^ mix(anchor + mix(at.astype(np.uint64)))), return_index=True, return_inverse=True, return_counts=True)
                    yield batch(
                        schema, _key=key[a + doc[at[one]]], start=(place[one] - begin[at[one]] + lo[at[one]]).astype(np.int32), n=n[one].astype(np.int32), anchor=anchor[one].view(np.int64), digest=digest[one].view(np.int64), times=times.astype(np.int32)
                    )
                    own = np.flatnonzero(times[which] > 1)
                    if len(own):
                        x, y, p = place[own], place[own] + n[own] + length - 1, at[own]
                        far = np.maximum.accumulate(y)
                        new = np.ones(len(own), bool)
                        new[1:] = (x[1:] > far[:-1]) | (p[1:] != p[:-1])
                        head = np.flatnonzero(new)
                        stop = far[np.append(head[1:], len(own)) - 1]
                        none = pa.nulls(len(head), pa.int64())
                        yield batch(schema, _key=key[a + doc[p[head]]], start=(x[head] - begin[p[head]] + lo[p[head]]).astype(np.int32), n=(stop - x[head]).astype(np.int32), anchor=none, digest=none, times=np.ones(len(head), np.int32))

    return run


def fetch_segments(unit: str, length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (_key, _text, wanted: [(start, n, anchor, single, hot)]) to segments with their symbols: bytes, or 64-bit
    word hashes."""
    symbols = UNITS[unit][0]
    schema = pa.schema([("anchor", pa.int64()), ("_key", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("single", pa.bool_()), ("hot", pa.bool_()), ("symbols", pa.binary())])

    def run(batches):
        for part in batches:
            data, offsets = utf8(part.column("_text"))
            key, wanted = part.column("_key").to_numpy(), part.column("wanted")
            at = wanted.offsets.to_numpy()
            start, n, anchor, single, hot = (wanted.values.field(x).to_numpy(zero_copy_only=False) for x in ("start", "n", "anchor", "single", "hot"))
            for a, b in runs(offsets, STEP):
                sym, first = symbols(data, offsets[a : b + 1])
                mine = slice(at[a], at[b])
                lo = start[mine] + np.repeat(first[:-1], np.diff(at[a : b + 1]))
                size = n[mine] + length - 1
                store = sym if unit == "words" else (sym - np.uint64(1)).astype(np.uint8)
                text = [store[x : x + s].tobytes() for x, s in zip(lo.tolist(), size.tolist(), strict=True)]
                yield batch(schema, anchor=anchor[mine], _key=np.repeat(key[a:b], np.diff(at[a : b + 1])), start=start[mine], size=size.astype(np.int32), single=single[mine], hot=hot[mine], symbols=pa.array(text, pa.binary()))

    return run


def group_again(unit: str, length: int, level: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of hot anchors to the groups of a level, which carry their symbols.  Those of the last level have none: a
    gram is the whole window there, and nothing is left to be told apart."""
    steps = grams(unit, length)
    gram, last = steps[level], level + 1 == len(steps)
    schema = pa.schema([("anchor", pa.int64()), ("_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.int64()), ("want", pa.bool_()), ("symbols", pa.binary())])

    def run(batches):
        for part in batches:
            data, offsets = utf8(part.column("symbols"))
            anchor, key, start, want = (part.column(x).to_numpy(zero_copy_only=False) for x in ("anchor", "_key", "start", "single"))
            for a, b in runs(offsets, STEP):
                store = data[offsets[a] : offsets[b]]
                sym = store.view(np.uint64) if unit == "words" else store.astype(np.uint64) + np.uint64(1)
                store = sym if unit == "words" else store
                edge = (offsets[a : b + 1] - offsets[a]) // (8 if unit == "words" else 1)
                place, n, chosen, digest = groups(sym, edge[:-1], edge[1:], length, gram, level)
                of = np.searchsorted(edge[1:], place, side="right")
                new = mix(chosen ^ mix(anchor[a + of].astype(np.int64).view(np.uint64)))
                text = [b""] * len(place) if last else [store[x : x + m].tobytes() for x, m in zip(place.tolist(), (n + length - 1).tolist(), strict=True)]
                yield batch(schema, anchor=new.view(np.int64), _key=key[a + of], start=(place - edge[of] + start[a + of]).astype(np.int32), n=n.astype(np.int32), digest=digest.view(np.int64), want=want[a + of], symbols=pa.array(text, pa.binary()))

    return run


def stretches(sym: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs [start, end) of at least ``length`` symbols within segments in which each ``gram``-gram (of 2 symbols at least) occurs elsewhere in
    the shard.  A repeated window lies in one of them."""
    none = np.zeros(0, np.int64)
    if len(sym) < length:
        return none, none
    h = gram_hash(sym, gram)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    often = np.zeros(len(h) + 2, bool)  # one more at both sides
    often[1 + order[1:][same]] = True
    often[1 + order[:-1][same]] = True
    behind = (offsets[1:, None] - np.arange(1, gram)).ravel()  # grams that would leave their segment
    often[1 + behind[(behind >= 0) & (behind < len(h))]] = False
    edge = np.flatnonzero(often[1:] != often[:-1])
    start, end = edge[::2], edge[1::2] + gram - 1
    long = end - start >= length
    return start[long], end[long]


def mark_shard(sym: np.ndarray, offsets: np.ndarray, length: int, gram: int, mark: Callable) -> np.ndarray:
    """Whether the window that starts at each symbol occurs at another place of the shard.

    What can't repeat is left out first, equal stretches are folded into one, and the index covers the rest.
    """
    found = np.zeros(len(sym), bool)
    wide = sym.astype(np.uint64) + np.uint64(1)
    start, end = stretches(wide, offsets, length, gram)
    if not len(start):
        return found
    _, first, which, often = np.unique(span_hash(prefix_hash(wide), start, end), return_index=True, return_inverse=True, return_counts=True)
    for a, b in zip(start[often[which] > 1].tolist(), end[often[which] > 1].tolist(), strict=True):
        found[a : b - length + 1] = True
    if (often == 1).any():
        a, n = start[first], (end - start)[first]
        inner = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(a - inner[:-1], n) + np.arange(inner[-1])
        here = mark(sym[place], inner, length)
        found[place[here]] = True
    return found


def index_shards(unit: str, length: int, mark: Callable, most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments sorted by anchor to spans.  ``mark(symbols, offsets, length)`` says for every symbol of a shard
    whether a window that starts there occurs at another place of the shard."""
    schema = pa.schema([("_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for shard in by_key(batches, "anchor", "size", most):
            data, offsets = utf8(shard.column("symbols"))
            sym = data[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            if unit == "words":
                sym, offsets = sym.view(np.uint64), offsets // 8
            found = mark_shard(sym, offsets, length, grams(unit, length)[0], mark)
            if not found.any():
                continue
            where = np.flatnonzero(found)
            new = np.ones(len(where), bool)
            seg = np.searchsorted(offsets, where, side="right") - 1
            new[1:] = (np.diff(where) > 1) | (np.diff(seg) > 0)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(where)) - 1
            seg = seg[head]
            base = shard.column("start").to_numpy()[seg] - offsets[seg]
            want = shard.column("single").to_numpy()[seg]
            yield batch(schema, _key=shard.column("_key").to_numpy()[seg][want], start=(base + where[head])[want].astype(np.int32), end=(base + where[tail] + length)[want].astype(np.int32))

    return run


def repeated_spans(docs: DataFrame, ws: Workspace, unit: str, length: int, mark: Callable, shard: int, most: int = MOST) -> DataFrame:
    """(_key, spans: [(start, end)]) of the documents (_key, _text) in which a window of ``length`` symbols occurs that
    also starts anywhere else; the spans cover the repeated windows and may overlap."""
    first = ws.table(docs.select("_key", "_text").mapInArrow(find_groups(unit, length), GROUP), "groups")
    spans = first.filter("anchor is null").select("_key", "start", (F.col("start") + F.col("n")).alias("end"))
    whole = F.col("start") + F.col("n") + (length - 1)
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    steps = grams(unit, length)
    # ``want``: whether the row's own windows are still to be decided on; if not, it only speaks for others
    found = first.filter("anchor is not null").withColumn("want", F.lit(True))
    for level in range(len(steps)):
        anchors = found.groupBy("anchor").agg(F.sum("times").alias("times"), F.min("digest").alias("low"), F.max("digest").alias("high")).filter("times > 1")
        anchors = ws.table(anchors.select("anchor", (F.col("low") == F.col("high")).alias("same")), "anchors")  # a table: a join with it can split hot anchors
        hits = ws.table(found.join(anchors, "anchor"), "hits")
        mixed = hits.filter("not same")
        kinds = ws.table(mixed.groupBy("anchor", "digest").agg(F.sum("times").alias("times"), F.max("want").alias("want"), F.min(F.struct("_key", "start", "n")).alias("place")), "kinds")
        # a table of its own: Spark splits a hot key's rows only in a stage with no more than the join's two inputs
        copies = ws.table(mixed.filter("want").join(kinds.filter("times > 1").select("anchor", "digest"), ["anchor", "digest"]).select("_key", "start", whole.alias("end")), "copies")
        spans = spans.unionByName(hits.filter("same and want").select("_key", "start", whole.alias("end"))).unionByName(copies)
        hot = ws.table(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > most).select("anchor", F.lit(True).alias("hot")), "hot")  # few rows, if any
        wanted = kinds.join(hot, "anchor", "left").select("anchor", "place.*", ((F.col("times") == 1) & F.col("want")).alias("single"), F.coalesce("hot", F.lit(False)).alias("hot"))
        if level == 0:
            wanted = wanted.groupBy("_key").agg(F.collect_list(F.struct("start", "n", "anchor", "single", "hot")).alias("wanted"))
            segments = docs.select("_key", "_text").join(wanted, "_key").mapInArrow(fetch_segments(unit, length), SEGMENT)
        else:  # only segments of hot anchors are left, and have their symbols with them
            segments = again.select("anchor", "_key", "start", "symbols").join(wanted, ["anchor", "_key", "start"])
            segments = segments.select("anchor", "_key", "start", (F.col("n") + (length - 1)).alias("size"), "single", "hot", "symbols")
        segments = ws.table(segments, "segments")
        marked = (
            segments.filter("not hot").select("anchor", "_key", "start", "size", "single", "symbols")
            .repartition(parts, "anchor").sortWithinPartitions("anchor")
            .mapInArrow(index_shards(unit, length, mark, shard), SPAN)
        )
        spans = spans.unionByName(marked)
        if level + 1 == len(steps) or hot.isEmpty():
            break
        again = ws.table(segments.filter("hot").mapInArrow(group_again(unit, length, level + 1), AGAIN), "again")
        found = again.select("_key", "start", "n", "anchor", "digest", F.lit(1).alias("times"), "want")
    return spans.groupBy("_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans of row i as maximal runs in ascending order."""
    one = spans[i].values if spans[i].is_valid else None
    if one is None or not len(one):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spans_union(one.field("start").to_numpy().astype(np.int64), one.field("end").to_numpy().astype(np.int64))
