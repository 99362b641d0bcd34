"""Periodic runs of words by divide and conquer on interned word ids (operator 12).

Main and Lorentz: cut a text in the middle; the runs that cross the middle follow from how far the text repeats itself,
forwards and backwards, at each distance from the middle (the Z-functions of the halves); the halves are searched in the
same way.  What a half sees of a run that leaves it is extended to the whole run, so runs that are found several times are
equal intervals: one stays, with its smallest period.

All middles of a level are handled at once, over all documents of a block, so the work is a few array operations for each of
the log2(words) levels.  Matches go on word by word for a few steps, then by bisection over hashes of prefixes, so a text
that is one long repetition costs no more than n log(n) of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lists, runs, utf8
from .windows import mix, prefix_hash, span_hash

#: Words of a run, at least; a run holds its period twice at least.
LEAST = 12
#: Steps of a match that are taken word by word.
STEPS = 6
#: Pairs of a middle and a distance that are looked at in one go.
PAIRS = 1 << 20
#: Bytes of texts that are searched at once; a longer text is alone.
BLOCK = 1 << 20


class Matches:
    """How far a sequence of symbols repeats itself from two places on."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self._prefix = None

    def _equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self._prefix is None:
            self._prefix = prefix_hash(mix(self.ids.astype(np.uint64) + np.uint64(1)))
        return span_hash(self._prefix, a, a + n) == span_hash(self._prefix, b, b + n)

    def length(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """Equal symbols from the places a and b on, ``limit`` at most; with step -1 those before a and b, backwards."""
        first = 0 if step > 0 else -1
        out = np.zeros(len(a), np.int64)
        on = np.flatnonzero(limit > 0)
        for k in range(STEPS):
            on = on[self.ids[a[on] + first + step * k] == self.ids[b[on] + first + step * k]]
            out[on] = k + 1
            on = on[limit[on] > k + 1]
            if not len(on):
                return out
        low, high = out[on], limit[on]  # low symbols are equal, more than high can't be
        while len(on):
            half = (low + high + 1) // 2
            shift = np.zeros_like(half) if step > 0 else half
            same = self._equal(a[on] - shift, b[on] - shift, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
            out[on] = low
            more = low < high
            on, low, high = on[more], low[more], high[more]
        return out


def _distances(count: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each i the distances 1..count[i]: arrays (i, distance) of ``most`` elements at most."""
    end = np.cumsum(count)
    for first in range(0, int(end[-1]), most):
        at = np.arange(first, min(first + most, int(end[-1])))
        which = np.searchsorted(end, at, "right")
        yield which, at - (end - count)[which] + 1


def periodic_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs within the documents that begin at ``first`` (one more at the end).

    A run has ``least`` symbols at least and twice its smallest period; sorted by start.  ``most`` pairs of a middle and a
    distance are looked at in one go, so the memory beside the symbols doesn't grow with the text.
    """
    match = Matches(ids)
    left, right = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    base, top = left, right  # of the document a segment belongs to
    found = []
    while True:
        big = right - left >= max(least, 2)
        if not big.any():
            break
        left, right, base, top = left[big], right[big], base[big], top[big]
        middle = (left + right) // 2
        for after in (True, False):  # the second copy of the period lies after the middle, or the first before it
            for seg, p in _distances(right - middle if after else middle - left, most):
                a = middle[seg] - (0 if after else p)
                b = a + p
                one = (b < right[seg]) & (ids[a] == ids[np.minimum(b, len(ids) - 1)])
                one |= (a > left[seg]) & (ids[a - 1] == ids[b - 1])
                seg, p, a, b = seg[one], p[one], a[one], b[one]
                ahead = match.length(a, b, right[seg] - b, 1)
                behind = match.length(a, b, a - left[seg], -1)
                good = ahead + behind >= p
                seg, p, start, end = seg[good], p[good], a[good] - behind[good], b[good] + ahead[good]
                _, one = np.unique(start * (len(ids) + 1) + end, return_index=True)  # distances ascend: the smallest stays
                seg, p, start, end = seg[one], p[one], start[one], end[one]
                # what ends at the segment's border may go on beyond it
                start = start - match.length(start, start + p, start - base[seg], -1)
                end = end + match.length(end - p, end, top[seg] - end, 1)
                long = end - start >= least
                found.append((start[long], end[long], p[long]))
        left, right, base, top = np.append(left, middle), np.append(middle, right), np.append(base, base), np.append(top, top)
    start, end, period = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    return start[new], end[new], period[new]


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a column of texts, and each text's first (one more at the end)."""
    split = pc.ascii_split_whitespace(column.fill_null(""))
    flat = split.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    place = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    at = split.offsets.to_numpy().astype(np.int64)
    return flat.filter(full), place[at - at[0]]


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(least: int):
    def run(batches):
        for part in batches:
            _, offsets = utf8(part.column("_text"))
            for x, y in runs(offsets, BLOCK):
                words, first = words_of(part.column("_text").slice(x, y - x))
                interned = words.dictionary_encode()
                ids = interned.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, end, period = periodic_runs(ids, first, least)
                # words after the first period of any run go
                depth = np.zeros(len(ids) + 1, np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, end, -1)
                kept = np.cumsum(depth[:-1]) == 0
                place = np.append(0, np.cumsum(kept))[first]
                left = pa.ListArray.from_arrays(pa.array(place, pa.int32()), words.filter(pa.array(kept)))
                bound = np.searchsorted(start, first)
                own = np.repeat(first[:-1], np.diff(bound))
                found = pa.StructArray.from_arrays([pa.array(start - own), pa.array(end - start), pa.array(period)], fields=list(_RUN))
                columns = {n: part.column(n).slice(x, y - x) for n in part.schema.names if n != "_text"}
                columns |= {"n_words": pa.array(np.diff(first)), "runs": lists(found, bound, _RUN), "collapsed": pc.binary_join(left, " ").cast(pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def collapse_runs(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The periodic runs of words of each text, and the text with one period left of each: doc_id, n_words, runs, collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch whose words repeat at a distance of its smallest
    period, twice that long at least and ``least`` words at least, that goes on at neither side.  ``runs`` has all of them
    by start, then period.  ``collapsed`` has the words that no run contains after its first period, joined by one space.

    One row per input row; rows are searched one by one, so repeated rows and ids give rows of their own and a null id
    stays null.  A null text has no words, no runs and collapses to the empty text.  Other columns are ignored.  No shuffle.
    """
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("_text"))
    return slim.mapInArrow(_search(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def _plant(batches):
    """Make the texts of one in ten ids periodic from some word on."""
    for part in batches:
        ids, texts = part.column("doc_id"), part.column("text")
        new = {}
        for i, key in enumerate(ids.to_pylist()):
            h = 1 if key is None else zlib.crc32(str(key).encode())
            if h % 10:
                continue
            words = words_of(texts.slice(i, 1))[0]
            n, g = len(words), h // 10
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                order = np.arange(n)
                order[a:] = a + (order[a:] - a) % p
                new[i] = " ".join(words.take(pa.array(order)).to_pylist())
        if new:
            mask = np.zeros(len(ids), bool)
            mask[list(new)] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(new.values()), texts.type))
        yield pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, those of one in ten ids (by CRC-32 of the id) made periodic from some word on."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_plant, "doc_id long, text string")


def summary(found: DataFrame) -> DataFrame:
    """Digest columns of ``collapse_runs``: the number of runs, the longest one (ties: smallest start, then period), hashes."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * (-best.less)) div best.period").alias("exponent_milli"), F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(collapse_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
