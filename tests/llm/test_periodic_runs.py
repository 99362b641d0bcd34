"""Periodic runs against a scan over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from slopewatch.llm import periodic_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("least", [2, 12])
def test_all_runs(least):
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([0, 1, 11, 12, 13, 40, 150]))]
            if len(w) > 4 and rng.random() < 0.6:
                a = rng.randrange(len(w))
                p = rng.randrange(1, len(w) - a + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            docs.append(w)
        first = np.cumsum([0] + [len(d) for d in docs])
        start, end, period = periodic_runs.periodic_runs(np.array(sum(docs, []), np.int64), first, least, rng.choice([5, 64, periodic_runs.PAIRS]))
        expected = [(s + first[i], n, q) for i, d in enumerate(docs) for s, n, q in brute(d, least)]
        assert list(zip(start, end - start, period, strict=True)) == expected


def test_one_long_repetition_takes_few_steps():
    start, end, period = periodic_runs.periodic_runs(np.zeros(300_000, np.int64), np.array([0, 300_000]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [300_000], [1])


def expected_row(key, text):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = set()
    for s, n, q in found:
        gone.update(range(s + q, s + n))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_query(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(30)]
    rows = []
    for i in range(300):
        text = rng.choice([" ", "\n", "  \t"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90)))
        rows.append((i, rng.choice(["", " ", "\v"]) + text))
    rows += [(400, None), (401, ""), (402, " \n"), (None, "a b " * 9), (403, "x " * 5000), (404, "a b a b " * 8), (404, "a b a b " * 8), (405, "one")]
    docs = spark.createDataFrame([(i, t, "other", [1], 5) for i, t in rows], "doc_id long, text string, runs string, best array<int>, n_words int")
    found = periodic_runs.summary(periodic_runs.collapse_runs(periodic_runs.planted(docs)))
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted((expected_row(i, t) for i, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10


def test_operator_keeps_to_its_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 6 + "d", "x")], "doc_id long, text string, collapsed string")
    row = periodic_runs.collapse_runs(docs).first()
    assert row.asDict(True) == {"doc_id": 1, "n_words": 19, "runs": [{"start": 0, "length": 18, "period": 3}], "collapsed": "a b c d"}
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in periodic_runs.op12_periodic_runs(spark, data).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        if len(r.text or "") < 4000:
            assert got[r.doc_id] == expected_row(r.doc_id, r.text)
