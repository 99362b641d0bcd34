"""Near duplicates of vectors against all pairs."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest

from slopewatch.llm import embedding_dedup as ed

SCHEMA = "vec_id long, label int, embedding array<double>, component_id string, _key int, n int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def expected(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, label, vector), by all pairs."""
    n = len(rows)
    near = [[] for _ in rows]
    groups = collections.defaultdict(list)
    for i, (_, label, v) in enumerate(rows):
        if label is not None and usable(v):
            groups[label, len(v)].append(i)
    for members in groups.values():
        u = np.array([np.array(rows[i][2], float) / max(abs(x) for x in rows[i][2]) for i in members])
        u /= np.sqrt((u * u).sum(1))[:, None]
        for a, b in zip(*np.nonzero(u @ u.T >= least), strict=True):
            if a != b:
                near[members[a]].append(members[b])
    label = list(range(n))
    for i in range(n):
        if label[i] == i:
            todo, part = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in part:
                        part.add(j)
                        todo.append(j)
            for j in part:
                label[j] = i
    low = collections.defaultdict(list)
    for i in range(n):
        low[label[i]].append(rows[i][0])
    out = []
    for i, (key, _, _) in enumerate(rows):
        first = min((x for x in low[label[i]] if x is not None), default=None)
        out.append((key, len(near[i]), first, key is not None and key == first))
    return sorted(out, key=str)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, ed.near_vectors(table, **options).collect()), key=str)


def around(rng, centre, n, spread):
    v = centre + rng.normal(0, spread, (n, len(centre)))
    return (v * rng.uniform(0.5, 2, (n, 1))).tolist()


def table(seed=0, dim=24):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=(8, dim))
    for c in centre:
        rows += [(1, v) for v in around(rng, c, 40, 0.12)] + [(2, v) for v in around(rng, c, 12, 0.2)]
    rows += [(1, v) for v in rng.normal(size=(500, dim)).tolist()]
    rows += [(1, rows[0][1])] * 30 + [(None, rows[0][1])] * 3 + [(2, rows[0][1])]
    rows += [(1, None), (1, []), (1, [0.0] * dim), (1, [None] + [1.0] * (dim - 1)), (1, [float("nan")] * dim), (1, [float("inf")] + [0.0] * (dim - 1))]
    rows += [(3, [1e300, 1e300]), (3, [1e-300, 1e-300]), (3, [5.0, 5.1]), (3, [1.0]), (3, [2.0]), (3, [-2.0])]
    order = rng.permutation(len(rows))
    rows = [(int(i) * 5, *rows[i]) for i in order]
    return [*rows, (rows[0][0], *rows[0][1:]), (None, *rows[1][1:]), (None, None, None)]


@pytest.mark.parametrize("options", [{}, {"cell": 16}, {"cell": 16, "long": 24, "family": 16}, {"cell": 1 << 20, "long": 24, "rounds": 0}], ids=["plain", "tables", "hubs and blocks", "cells in blocks"])
def test_all_pairs(spark, options):
    rows = table()
    want = expected(rows)
    assert max(r[1] for r in want) > 20
    assert found(spark, rows, **options) == want


def test_another_threshold(spark):
    rows = table(3, 16)
    assert found(spark, rows, least=0.9, cell=64) == expected(rows, 0.9)


def test_empty_and_tiny(spark):
    assert found(spark, []) == []
    assert found(spark, [(4, 1, [1.0, 0.0])]) == [(4, 0, 4, True)]
    assert found(spark, [(4, 1, [1.0, 0.0]), (2, 1, [1.0, 0.01]), (3, 1, [0.0, 1.0])]) == [(2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    v = base + rng.normal(0, 0.1, (600, 64))
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    centre, cosine = unit.mean(0), unit @ unit.T
    off = ~np.eye(len(unit), dtype=bool)
    error = np.mean([(ed.Codes(unit, centre, seed).upper(slice(0, 600), ed.Codes(unit, centre, seed), 0.0) - cosine)[off].mean() for seed in range(5)])
    assert abs(error) < 2e-5
    codes = ed.Codes(unit, centre)
    assert (codes.upper(slice(0, 600), codes, ed.SURE) >= cosine - 1e-12).all()


def test_bounds_rule_out_what_need_not_be_recomputed():
    rng = np.random.default_rng(5)
    v = np.concatenate([c + rng.normal(0, 0.02, (100, 64)) for c in rng.normal(size=(1, 64)) + rng.normal(0, 0.25, (10, 64))])
    length = np.sqrt((v * v).sum(1))
    links, root, exact = ed.count_links(v, length, np.zeros(len(v), int), np.ones(len(v), int), 0.98)
    assert links.tolist() == ((v @ v.T / np.outer(length, length) >= 0.98).sum(1) - 1).tolist()
    assert exact < 0.2 * len(v) * (len(v) - 1) / 2


def test_a_pair_at_the_threshold_is_hardly_ever_missed():
    plan = ed.Plan(0.98)
    assert plan.limit == 40
    for rows in (10, 1000, 10**5, 10**7, 10**9):
        bits, tables = plan.tables(rows, 256)
        assert rows / 2**bits < 512 and (1 - (1 - plan.flip) ** bits) ** tables <= 1e-7


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert sorted(map(tuple, ed.op11_embedding_dedup(spark, data).collect()), key=str) == expected(rows)
