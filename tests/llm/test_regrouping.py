"""Rows made when windows of a gram that very many texts share are grouped anew."""

from __future__ import annotations

import collections
import random

import pytest

from slopewatch.llm import repeats, suffix_array_dedup
from slopewatch.llm.common import Workspace


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that a workspace writes, by name."""
    rows, table = collections.Counter(), Workspace.table

    def counted(self, df, name):
        out = table(self, df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(Workspace, "table", counted)
    return rows


def test_regrouped_windows_stay_in_few_rows(spark, written):
    """A passage longer than a window in many texts: windows that straddle its ends share all grams but the whole one."""
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    passage, n = noise(500), 40
    texts = [noise(450) + passage + noise(450) for _ in range(n)]
    docs = spark.createDataFrame([*enumerate(texts), (n, noise(2000))], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_array_dedup.suffix_array_dedup(docs, most=4).collect()}
    same = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for i, t in enumerate(texts):
        gone = {p for x in range(len(t) - 399) if same[t[x : x + 400]] > 1 for p in range(x, x + 400)}
        assert got[i] == (len(gone), 1)
    assert got[n] == (0, 0)
    assert n < written["again"] < 100 * n


@pytest.mark.parametrize(("unit", "length"), [("bytes", 400), ("bytes", 2), ("bytes", 33), ("words", 35), ("words", 51), ("words", 8)])
def test_choices_shrink_by_a_bounded_factor(unit, length):
    steps = repeats.grams(unit, length)
    assert steps[-1] == length and steps == sorted(set(steps))
    rest = [length - g + 1 for g in steps]
    assert all(a <= 5 * b or b < 4 or a - b <= repeats.UNITS[unit][1] << 4 and 2 * (length - a + 1) >= length - b + 1 for a, b in zip(rest, rest[1:], strict=False))
