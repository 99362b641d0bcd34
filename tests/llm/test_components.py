"""Connected components: edges that the rounds meet, and results against union and find."""

from __future__ import annotations

import collections
import random

import pytest

from slopewatch.llm.common import Workspace
from slopewatch.llm.components import components


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


def test_members_of_many_lists_have_few_edges(spark, written):
    members, lists = 300, 15
    edges = [(hub, 1000 + i) for i in range(members) for hub in range(lists)] + [(5000, 5001), (5002, 5001), (5003, 5002), (7, 7), (1001, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    assert got == {**{i: 0 for i in [*range(lists), *range(1000, 1000 + members)]}, **{i: 5000 for i in range(5000, 5004)}}
    assert written["edges"] < 3 * (members + lists)


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    for n, m in ((40, 25), (60, 80), (50, 0)):
        edges = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1030)]
        root = {v: v for e in edges for v in e}

        def find(v, root=root):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        linked = {v for a, b in edges if a != b for v in (a, b)}
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
        assert got == {v: find(v) for v in linked}
